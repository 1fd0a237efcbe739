"""Removal of repeated byte strings with suffix arrays built by induced sorting, shard by shard.

A ``width``-byte string's seed is the least-hashed ``SEED``-byte string inside it.  Equal strings have equal seeds at the
same place in them, so the strings that share a seed form a shard's worth of work that needs no other text:

1. Texts are packed into blocks.  Each block lists its seeds; those that occur once in the whole corpus are done
   with, as no string around them can repeat.
2. Neighbouring strings with one seed in common form a run of text.  Equal runs, known by a 128-bit digest, are kept once with their number.
3. The different runs of a seed go to one shard.  Its suffix array is sorted by induction, and permuted common
   prefixes show which strings occur twice.  A seed with more than ``HOT_RUNS`` different runs is not gathered: the
   digests of its strings are counted as rows instead.
4. Blocks get back which strings of their runs repeat, and cut the bytes these cover.

Results are exact up to digests of 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.common import materialize
from tollway.llm.ppm import _unpack, pack_blocks

WIDTH, SEED = 200, 48
BLOCK_BYTES = 4 << 20
#: Bytes of runs that are sorted together, and runs of a seed after which it is counted by rows.
SHARD_BYTES, HOT_RUNS = 1 << 20, 4000
#: Bytes whose seeds are found at once.
STEP = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)


# ---- seeds ----

def seed_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size``-byte string, by doubling the length of hashed strings."""

    with np.errstate(over="ignore"):
        h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        out, covered, length, factor = None, 0, 1, _BASE
        while True:
            if size & length:
                if out is None:
                    out, covered = h, length
                else:
                    n = len(raw) - covered - length + 1
                    out = out[:n] * factor + h[covered : covered + n]
                    covered += length
            if covered == size:
                break
            n = len(raw) - 2 * length + 1
            h = h[:n] * factor + h[length : length + n]
            length, factor = 2 * length, factor * factor
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def window_least(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``size`` hashes in a row and its place; the leftmost of equal ones."""

    place, length = np.arange(len(h), dtype=np.int32), 1
    while length < size:
        step = min(length, size - length)  # two overlapping stretches cover the last one
        right = h[step:] < h[:-step]
        place = np.where(right, place[step:], place[:-step])
        h = np.minimum(h[step:], h[:-step])
        length += step
    return h, place


def seeds_at(raw: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the seed of each ``width``-byte string, worked out in pieces that stay in the cache."""

    hashes, places = [], []
    for start in range(0, len(raw) - width + 1, STEP):
        part = raw[start : start + STEP + width - 1]
        h, place = window_least(seed_hashes(part, seed), width - seed + 1)
        hashes.append(h)
        places.append(place + start)
    return np.concatenate(hashes), np.concatenate(places)


def runs_of(texts: list[bytes], width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one seed, in all texts joined: the first string's start, the number of strings, the seed's hash."""

    none = np.zeros(0, dtype=np.int64)
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(joined) < width:
        return none, none, none
    h, place = seeds_at(joined, width, seed)
    size = np.array([len(t) for t in texts])
    end = np.repeat(np.cumsum(size).astype(np.int32), size)[: len(place)]  # of the text that a byte is in
    starts = np.flatnonzero(np.arange(len(place), dtype=np.int32) <= end - width).astype(np.int32)
    if not len(starts):
        return none, none, none
    place, end = place[starts], end[starts]
    new = (place[1:] != place[:-1]) | (end[1:] != end[:-1])
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    del place, end, new
    return starts[first], np.diff(np.append(first, len(starts))), h[starts[first]].view(np.int64)


def _block(parts: list[bytes]) -> list[tuple]:
    return [row for data in parts for row in _unpack(data)]


def _seeds(blocks: DataFrame, width: int, seed: int) -> DataFrame:
    """(block, seed, n): how many runs of a block have a seed; and one row per block with all its runs, packed."""

    names = ["block", "seed", "n", "starts", "sizes", "seeds"]
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64())]

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                start, size, value = runs_of([t for _, _, t in _unpack(data)], width, seed)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, *(pa.array([x.tobytes()], pa.binary()) for x in (start.astype("<i4"), size.astype("<i4"), value.astype("<i8")))], names=names)
                value, n = np.unique(value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), block)), pa.array(value), pa.array(n), *(pa.nulls(len(value), pa.binary()) for _ in range(3))], names=names)

    return blocks.mapInArrow(run, "block long, seed long, n long, starts binary, sizes binary, seeds binary")


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _occurrences(blocks: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(block, seed, key, starts, size) of the runs that have a repeated seed; equal runs of a block are one row.

    ``wanted`` has the repeated seeds of a block and the row with its packed runs.
    """

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        joined = b"".join(t for _, _, t in _block(left.column("data").to_pylist()))
        packed = right.filter(pc.is_valid(right.column("starts")))
        start, size, value = (np.frombuffer(b"".join(packed.column(c).to_pylist()), dtype=t) for c, t in (("starts", "<i4"), ("sizes", "<i4"), ("seeds", "<i8")))
        known = np.isin(value, right.column("seed").drop_null().to_numpy())
        found: dict[tuple, list] = {}
        for a, n, v in zip(start[known].tolist(), size[known].tolist(), value[known].tolist(), strict=True):
            found.setdefault((v, digest(joined[a : a + n + width - 1]), n), []).append(a)
        block = left.column("block")[0].as_py() if left.num_rows else None
        return pa.table({
            "block": pa.array([block] * len(found), pa.int64()), "seed": pa.array([k[0] for k in found], pa.int64()), "key": pa.array([k[1] for k in found], pa.binary()),
            "starts": pa.array(list(found.values()), pa.list_(pa.int32())), "size": pa.array([k[2] for k in found], pa.int32()),
        })

    return blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(of_block, "block long, seed long, key binary, starts array<int>, size int")


def _contents(blocks: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(seed, key, n, text): the bytes of runs, each from one of its places."""

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        joined = b"".join(t for _, _, t in _block(left.column("data").to_pylist()))
        text = [joined[a : a + n + width - 1] for a, n in zip(right.column("start").to_pylist(), right.column("size").to_pylist(), strict=True)]
        return pa.table({"seed": right.column("seed"), "key": right.column("key"), "n": right.column("n"), "text": pa.array(text, pa.binary())})

    return blocks.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(of_block, "seed long, key binary, n long, text binary")


# ---- suffix arrays by induced sorting ----

def _types(x: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last, empty but for its end, is."""

    n = len(x)
    step = np.sign(np.diff(x.astype(np.int32)))
    nearest = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]  # the next place at which characters differ
    out = np.ones(n, dtype=bool)
    out[:-1] = np.append(step, 1)[nearest] > 0
    return out


def _deal(lists: list, x: np.ndarray, places: np.ndarray) -> None:
    """Appends places to the list of their character, in order."""

    if not len(places):
        return
    c = x[places]
    order = np.argsort(c, kind="stable")
    places, c = places[order], c[order]
    cuts = np.flatnonzero(np.diff(c)) + 1
    for part, ch in zip(np.split(places, cuts), c[np.append(0, cuts)].tolist(), strict=True):
        lists[ch].append(part)


def _induce(x: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray, top: int) -> np.ndarray:
    """All suffixes in order, from the order of the leftmost-smaller ones.

    Characters are taken in turn; of one character's suffixes, those that are larger than the next one follow from suffixes
    placed before, scanned upwards, and the smaller ones from those placed behind, scanned downwards.
    """

    empty = np.zeros(0, dtype=np.int64)
    heads: list[list] = [[] for _ in range(top)]
    _deal(heads, x, sorted_lms)
    lms = [np.concatenate(h) if h else empty for h in heads]
    larger: list = [[] for _ in range(top)]
    done_larger: list = [empty] * top

    def before(places: np.ndarray, want_small: bool) -> np.ndarray:
        p = places[places > 0] - 1
        return p[small[p] == want_small]

    for c in range(top):
        rounds, now = [], np.concatenate(larger[c]) if larger[c] else empty
        while len(now):
            rounds.append(now)
            p = before(now, False)
            same = x[p] == c
            _deal(larger, x, p[~same])
            now = p[same]
        done_larger[c] = np.concatenate(rounds) if rounds else empty
        _deal(larger, x, before(lms[c], False))
    smaller: list = [[] for _ in range(top)]
    smaller[int(x[-1])].append(np.array([len(x) - 1], dtype=np.int64))  # the end, below all others
    out: list = [empty] * top
    for c in range(top - 1, -1, -1):
        rounds, now = [], np.concatenate(smaller[c]) if smaller[c] else empty
        while len(now):
            rounds.append(now)
            p = before(now, True)
            same = x[p] == c
            _deal(smaller, x, p[~same])
            now = p[same]
        _deal(smaller, x, before(done_larger[c][::-1], True))
        out[c] = np.concatenate([done_larger[c], *(r[::-1] for r in rounds[::-1])])
    return np.concatenate(out)


def _names(x: np.ndarray, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of leftmost-smaller substrings given in order: equal substrings get equal names."""

    a, b = order[:-1], order[1:]
    size = ends[a] - a
    differs = size != ends[b] - b
    going = np.flatnonzero(~differs)
    k = 0
    while len(going):
        going = going[size[going] >= k]
        unequal = x[a[going] + k] != x[b[going] + k]
        differs[going[unequal]] = True
        going = going[~unequal]
        k += 1
    return np.concatenate([[0], np.cumsum(differs)])


def _sort_names(name: np.ndarray, enough: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by recursion: pairs of names get names, until all differ or span ``enough`` names."""

    span = 1
    while span < enough and int(name.max()) + 1 < len(name):
        follow = np.zeros(len(name), dtype=np.int64)
        follow[: len(name) - span] = name[span:] + 1
        pair = name * (int(name.max()) + 2) + follow
        order = np.argsort(pair, kind="stable")
        new = np.empty(len(name), dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        name, span = new, 2 * span
    return np.argsort(name, kind="stable")


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a text of small numbers whose last one is 0, in the order of at least their first ``depth`` characters."""

    x = x.astype(np.int64)
    small = _types(x)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    top = int(x.max()) + 1
    if len(lms) > 1:
        rough = _induce(x, small, lms, top)
        is_lms = np.zeros(len(x), dtype=bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]
        ends = np.zeros(len(x), dtype=np.int64)  # a substring reaches to the next leftmost-smaller place
        ends[lms] = np.append(lms[1:], len(x) - 1)
        name = np.empty(len(x), dtype=np.int64)
        name[order] = _names(x, order, ends)
        lms = lms[_sort_names(name[lms], depth // 2 + 1)]  # a name spans two characters at least
    return _induce(x, small, lms, top)


def common_prefixes(raw: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """In text order, the common prefix of each suffix with the one before it in the array, up to ``depth`` (a multiple of 8)."""

    n = len(raw)
    before = np.full(n, -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    padded = np.concatenate([raw, np.zeros(depth + 8, dtype=np.uint8)])
    words = np.ndarray(shape=(n + depth,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    out = np.zeros(n, dtype=np.int32)
    going = np.flatnonzero(before >= 0)
    for k in range(0, depth, 8):
        going = going[words[going + k] == words[before[going] + k]]
        out[going] = k + 8
    return out


def repeated_in_shard(texts: list[bytes], times: list[int], width: int) -> list[np.ndarray]:
    """For each text, which of its ``width``-byte strings occur more than once in the shard."""

    size = np.array([len(t) for t in texts])
    starts = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
    x = joined.astype(np.int64) + 1
    x[starts + size] = 0
    suffixes = suffix_array(x, width)
    left = np.repeat(starts + size, size + 1) - np.arange(len(x)) >= width  # strings that end within their text
    words = width - width % 8
    prefix = common_prefixes(joined, suffixes, words)
    before = np.full(len(x), -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    equal = np.flatnonzero((prefix >= words) & left & (before >= 0))
    equal = equal[left[before[equal]]]
    for k in range(words, width):
        equal = equal[joined[equal + k] == joined[before[equal] + k]]
    twice = np.zeros(len(x), dtype=bool)
    twice[equal] = True
    twice[before[equal]] = True
    return [np.ones(n - width + 1, dtype=bool) if k > 1 else twice[a : a + n - width + 1] for a, n, k in zip(starts.tolist(), size.tolist(), times, strict=True)]


def spans(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true flags, in turn."""

    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel().tolist()


def _sort_shards(width: int, shard_bytes: int):
    """Sorts the runs of whole seeds together, about ``shard_bytes`` at a time; rows come ordered by seed."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_in_shard([r[3] for r in rows], [r[2] for r in rows], width)
        keys, parts = zip(*[(r[1], spans(f)) for r, f in zip(rows, found, strict=True)], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(parts, pa.list_(pa.int32()))], names=["key", "spans"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("seed", "key", "n", "text")), strict=True):
                if size >= shard_bytes and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    return run


def _hot_strings(width: int):
    """(seed, key, at, string): the digest of every string of a run."""

    def run(batches):
        for batch in batches:
            for seed, key, n, text in zip(*(batch.column(c).to_pylist() for c in ("seed", "key", "n", "text")), strict=True):
                m = len(text) - width + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([seed] * m, pa.int64()), pa.array([key] * m, pa.binary()), pa.array([n] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([digest(text[k : k + width]) for k in range(m)], pa.binary()),
                ], names=["seed", "key", "n", "at", "string"])

    return run


def _repeats(blocks: DataFrame, places: DataFrame, width: int, hot_runs: int, shard_bytes: int) -> DataFrame:
    """(key, spans) of the runs with strings that occur more than once: starts and ends among the run's strings."""

    known = materialize(places.groupBy("seed", "key", "size").agg(F.sum(F.size("starts")).cast("long").alias("n"), F.min(F.struct("block", F.col("starts")[0].alias("start"))).alias("at")).select("seed", "key", "size", "n", "at.block", "at.start"), "runs")
    of_seed = known.groupBy("seed").agg(F.count("*").alias("runs"), F.sum("n").alias("all")).filter("all > 1")
    # a run alone in its seed is a shard of one text: all its strings repeat with it
    alone = known.join(of_seed.filter("runs = 1"), "seed").select("key", F.array(F.lit(0), F.col("size")).alias("spans"))
    several = known.join(of_seed.filter("runs > 1"), "seed")
    texts = materialize(_contents(blocks, several.select("seed", "key", "n", "size", "block", "start"), width), "run-texts")
    hot = texts.groupBy("seed").count().filter(F.col("count") > hot_runs).select("seed")
    cold = texts.join(hot, "seed", "left_anti").repartition("seed").sortWithinPartitions("seed", "key")
    sorted_ = cold.mapInArrow(_sort_shards(width, shard_bytes), "key binary, spans array<int>")
    strings = materialize(texts.join(hot, "seed", "left_semi").mapInArrow(_hot_strings(width), "seed long, key binary, n long, at int, string binary"), "hot-strings")
    often = strings.groupBy("string").agg(F.sum("n").alias("times")).filter("times > 1").select("string")
    counted = strings.join(often, "string", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    by_rows = counted.select("key", F.flatten(F.transform("ats", lambda a: F.array(a, a + 1))).alias("spans"))
    return alone.unionByName(sorted_).unionByName(by_rows).filter(F.size("spans") > 0)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(width: int):
    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _block(left.column("data").to_pylist())
        size = np.array([len(t) for _, _, t in rows])
        change = np.zeros(int(size.sum()) + 1, dtype=np.int32)
        for starts, parts in zip(right.column("starts").to_pylist(), right.column("spans").to_pylist(), strict=True):
            parts = np.array(parts, dtype=np.int64).reshape(-1, 2)
            for a in starts:
                np.add.at(change, a + parts[:, 0], 1)
                np.add.at(change, a + parts[:, 1] - 1 + width, -1)
        covered = np.cumsum(change[:-1]) > 0
        out: list[list] = [[] for _ in range(6)]
        at = 0
        for doc_id, _, text in rows:
            gone = covered[at : at + len(text)]
            at += len(text)
            kept = text if not gone.any() else np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            for column, value in zip(out, (doc_id, len(text), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

    return of_block


def remove_repeats(docs: DataFrame, width: int = WIDTH, seed: int = SEED, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    Every byte that a ``width``-byte string covers is removed if that string also starts anywhere else in any row, its
    own included; strings never cross rows and are judged on the input.  Null and empty texts are no bytes.  Rows
    with equal texts or ids are rows of their own, so a text of ``width`` bytes that comes twice goes whole from both.
    Further columns are not read; no rows give none.
    """

    if not 8 <= seed < width:
        raise ValueError("a seed is shorter than the strings")
    blocks = materialize(pack_blocks(docs, block_bytes, block_bytes, lower=False), "repeat-blocks")
    seeds = materialize(_seeds(blocks, width, seed), "repeat-seeds")
    single = seeds.filter("starts is null").select("block", "seed", "n")
    often = single.groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1").select("seed")
    wanted = single.select("block", "seed").join(often, "seed", "left_semi").unionByName(seeds.filter("starts is not null").select("block", "starts", "sizes", "seeds"), allowMissingColumns=True)
    places = materialize(_occurrences(blocks, wanted, width), "repeat-runs")
    found = _repeats(blocks, places.filter("block is not null"), width, hot_runs, shard_bytes)
    cuts = places.join(found, "key").select("block", "starts", "spans")
    return blocks.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_cut(width), RESULT)
