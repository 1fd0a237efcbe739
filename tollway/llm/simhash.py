"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

Distinct fingerprints are cut into bands of bits.  Two that differ in at most ``radius`` bits agree in
at least one of ``radius + 1`` bands, so comparing the fingerprints that share a band's value
finds every link.  Those are compared as tiles, by numpy's exclusive-or and bit counts; within a tile
fingerprints are sorted by population count, and parts whose counts differ by more than the
radius are skipped.  A band value that many fingerprints share is split over tile pairs that are tasks
of their own.  A tile hands on a spanning star of each group it finds, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.common import map_slices, materialize, rows_hash, utf8
from tollway.llm.graph import components

SHINGLE, BITS, RADIUS = 4, 64, 4
#: Fingerprints of a tile; a band value with more is split over pairs of tiles.
TILE = 2048
#: Side of the parts of a tile that are compared or skipped at once.
PART = 256


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of words, repeats included; of all words if there are fewer; none without words."""

    found = utf8(text).lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(found))
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    starts = np.cumsum(sizes + 1) - sizes - 1
    k = min(width, len(found))
    last = len(found) - k + 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), (starts + sizes)[k - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it; no hashes give zero."""

    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    octets = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for start in range(0, n, 255):  # so that sums fit one byte
        counts += np.add.reduce(np.unpackbits(octets[start : start + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (the text's hash) and fp (the fingerprint's 64 bits as a long) of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t)) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(fps)], names=["doc_id", "tie", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rows_hash().alias("tie"), "text")
    return map_slices(rows, work, "doc_id long, tie long, fp long")


def tile_links(fps: np.ndarray, radius: int, part: int = PART, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join the same fingerprints as all pairs within the radius do.

    With ``apart``, a boolean side per fingerprint, only pairs from different sides are compared.
    """

    bits = np.bitwise_count(fps.view(np.uint64)).astype(np.int16)
    order = np.argsort(bits, kind="stable")
    fps, bits = fps[order], bits[order]
    side = None if apart is None else apart[order]
    words = fps.view(np.uint64)
    rows, columns = [], []
    n = len(fps)
    for a in range(0, n, part):
        for b in range(a, n, part):
            if bits[b] - bits[min(a + part, n) - 1] > radius:
                break  # all later parts have even more bits
            near = np.bitwise_count(words[a : a + part, None] ^ words[None, b : b + part]) <= radius
            if side is not None:
                near &= side[a : a + part, None] != side[None, b : b + part]
            elif a == b:
                near = np.triu(near, 1)
            if near.any():
                i, j = np.nonzero(near)
                i, j = i + a, j + b
                if len(i) > 4 * part:  # many links: keep a star of each group
                    nodes, both = np.unique(np.concatenate([i, j]), return_inverse=True)
                    i, j = (nodes[x] for x in _star(both[: len(i)], both[len(i) :]))
                rows.append(i)
                columns.append(j)
    if not rows:
        return fps[:0], fps[:0]
    i, j = _star(np.concatenate(rows), np.concatenate(columns))
    return fps[i], fps[j]


def _star(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link per node to the least node of its group."""

    label = np.arange(int(max(i.max(), j.max())) + 1)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    node = np.nonzero(label != np.arange(len(label)))[0]
    return node, label[node]


def bands(radius: int = RADIUS) -> list[tuple[int, int]]:
    """Shift and width of each of ``radius + 1`` bands."""

    edges = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _streams(radius: int):
    """Compares the rows of each tile of a partition sorted by tile."""

    def out(fps: np.ndarray, sides: np.ndarray):
        apart = None if (sides == 0).all() else sides == 2
        u, v = tile_links(fps, radius, apart=apart)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches):
        left = None  # the last tile of the rows before, which may go on
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("band", "value", "pair", "side", "fp")]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:3]], axis=0)) + 1
            cuts = [0, *new.tolist()]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    yield out(now[4][a:b], now[3][a:b])
            left = [x[cuts[-1] :] for x in now]
        if left is not None and len(left[0]) > 1:
            yield out(left[4], left[3])

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) of distinct fingerprints fp: enough of the pairs within the radius to connect all that they connect.

    A band value with up to ``tile`` fingerprints is one tile.  More are split by population count and
    hash into tiles of about that size, and each pair of tiles whose counts are within the radius is
    compared apart from the others.
    """

    cut = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for k, (shift, width) in enumerate(bands(radius))])
    rows = materialize(fps.select("fp", F.explode(cut).alias("b")).select("b.band", "b.value", "fp", F.bit_count("fp").alias("pop")), "bands")
    classes = rows.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("band", "value").agg(F.sum("n").alias("total")).filter("total > 1")
    small = rows.join(sizes.filter(F.col("total") <= tile), ["band", "value"]).select("band", "value", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), "fp")
    split = classes.join(sizes.filter(F.col("total") > tile), ["band", "value"]).select("band", "value", "pop", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    cells = materialize(split.select("band", "value", "pop", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "tiles")
    first, other = cells.alias("a"), cells.alias("b")
    near = first.join(other, (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("b.pop") - F.col("a.pop")).between(0, radius) & ((F.col("b.pop") > F.col("a.pop")) | (F.col("b.part") >= F.col("a.part"))))
    name = F.xxhash64("a.pop", "a.part", "b.pop", "b.part")
    same = (F.col("a.pop") == F.col("b.pop")) & (F.col("a.part") == F.col("b.part"))
    as_first = near.select("a.band", "a.value", "a.pop", "a.part", name.alias("pair"), F.when(same, 0).otherwise(1).alias("side"))
    as_other = near.filter(~same).select("b.band", "b.value", "b.pop", "b.part", name.alias("pair"), F.lit(2).alias("side"))
    placed = rows.join(split, ["band", "value", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    large = placed.join(as_first.unionByName(as_other), ["band", "value", "pop", "part"]).select("band", "value", "pair", "side", "fp")
    tiles = small.unionByName(large).repartition("band", "value", "pair").sortWithinPartitions("band", "value", "pair")
    return tiles.mapInArrow(_streams(radius), "u long, v long")


def groups(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, root) of every distinct fingerprint that has a link; the root is the group's least fingerprint."""

    distinct = prints.select("fp").distinct()
    return components(links(distinct, radius, tile)).select(F.col("node").alias("fp"), "root")


def clusters(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Texts without words (null, empty, blank) have fingerprint zero and link like others.  Equal
    fingerprints are one node, so copies cost nothing beyond their row.  component_id is the least
    doc_id of the component; null if all its ids are null.  Further columns are not read.
    """

    prints = materialize(fingerprints(docs), "fingerprints")
    grouped = materialize(groups(prints, radius, tile), "groups")
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(grouped, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    per_root = per_print.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(per_print.join(per_root, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One document of each component, with all columns: the one with the least doc_id, nulls last.

    Among rows of that id, the one with the least text hash; among rows equal in both, any one.
    """

    names = docs.columns
    prints = materialize(fingerprints(docs), "fingerprints")
    grouped = materialize(groups(prints, radius, tile), "groups")
    rooted = prints.join(grouped, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("best")).select("best.doc_id", "best.tie")
    often = prints.groupBy("doc_id", "tie").agg(F.count("*").alias("times"))
    chosen = best.alias("b").join(often.alias("o"), F.col("b.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("b.tie") == F.col("o.tie"))).select("b.doc_id", "b.tie", "times")
    chosen = materialize(chosen, "chosen")
    # the row itself is one struct, so that no column of it can clash with those added here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), rows_hash().alias("tie"))

    def matching(keys: DataFrame) -> DataFrame:
        k = keys.alias("k")
        return rows.alias("r").join(k, F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.tie") == F.col("k.tie")), "left_semi")

    single = matching(chosen.filter("times = 1")).select("row.*")
    if chosen.filter("times > 1").isEmpty():
        return single
    return single.unionByName(matching(chosen.filter("times > 1")).groupBy("doc_id", "tie").agg(F.first("row").alias("row")).select("row.*"))
