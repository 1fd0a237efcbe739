"""Language-model scores by prediction by partial matching, beside a word-unigram base score.

The model is a trie of byte contexts up to ``ORDER`` bytes with the counts of the bytes that follow them
in the training texts.  A byte is predicted from the longest context that has been seen; if it did not
follow there, an escape (method D: half a count per distinct byte) leads to the context that is one
byte shorter, with the bytes already ruled out excluded, and in the end to all bytes alike.  A text's score is
the sum of log10 probabilities of its bytes and of its end.

How the work is laid out: texts are packed into blocks of bounded size.  Each block lists its distinct
byte grams and words with their training counts; the counts are added up over all blocks, the trie's
probabilities are worked out once per distinct gram, and each block gets back the values of its own
grams and words only, as a stream sorted by gram.  So nothing is broadcast that grows with the corpus, but for the counts of
contexts of up to one byte (at most 257 x 257 numbers), and no task holds more than its block.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.common import materialize, slices, utf8

ORDER = 5
#: Text bytes of a block.
BLOCK_BYTES = 24 << 20
#: Text bytes whose grams are worked on at once.
STEP_BYTES = 2 << 20
#: Bytes that UTF-8 never has: before a text's start, and its end.
PAD, END = 0xFE, 0xFF
#: Symbols of the last resort: 256 byte values and the end.
SYMBOLS = 257
_PAD = bytes([PAD]) * ORDER
_LOW = 16  # bits of a gram that are kept apart from its prefix in packed lists


def held_out(doc_id) -> F.Column:
    """Rows that the model does not learn from; a null id is learned from."""

    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- blocks ----

def _pack(rows: list[tuple]) -> bytes:
    """Rows (doc_id, learns, text) as one compressed value."""

    head = [struct.pack("<q??I", r[0] or 0, r[0] is not None, r[1], len(r[2])) for r in rows]
    return zlib.compress(struct.pack("<I", len(rows)) + b"".join(head) + b"".join(r[2] for r in rows), 1)


def _unpack(data: bytes) -> list[tuple]:
    raw = memoryview(zlib.decompress(data))
    (n,) = struct.unpack_from("<I", raw)
    size = struct.calcsize("<q??I")
    out, at = [], 4 + n * size
    for i in range(n):
        doc_id, known, learns, length = struct.unpack_from("<q??I", raw, 4 + i * size)
        out.append((doc_id if known else None, learns, bytes(raw[at : at + length])))
        at += length
    return out


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, step_bytes: int = STEP_BYTES, lower: bool = True) -> DataFrame:
    """(block, data): texts, with A-Z lowered if asked, packed; a block never has more than ``block_bytes`` and one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(number: int, held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_pack(held)], pa.binary())], names=["local", "data"])

        number = total = size = 0
        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                for doc_id, learns, text in zip(part.column("doc_id").to_pylist(), part.column("learns").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = utf8(text).lower() if lower else utf8(text)
                    if held and (size + len(raw) > step_bytes or total + len(raw) > block_bytes):
                        yield out(number, held)
                        held, size = [], 0
                        if total + len(raw) > block_bytes:
                            number, total = number + 1, 0
                    held.append((doc_id, learns, raw))
                    size += len(raw) + 16
                    total += len(raw) + 16
        if held:
            yield out(number, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("learns"), "text")
    packed = rows.mapInArrow(run, "local long, data binary")
    # ids are written at once, so that every later reader sees the same ones
    return packed.select((F.spark_partition_id().cast("long") * (1 << 24) + F.col("local")).alias("block"), "data")


# ---- grams ----

def gram_codes(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """Each byte of the texts, and each text's end, as a number that holds it and the ``order`` bytes before it."""

    joined = np.frombuffer(b"".join([_PAD[:order] + t + b"\xff" for t in texts]), dtype=np.uint8)
    n = max(0, len(joined) - order)
    code = np.zeros(n, dtype=np.int64)
    for j in range(order + 1):
        code <<= 8
        code |= joined[j : j + n]
    return code[(joined[order:] != PAD)]


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their summed counts."""

    if not codes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, dtype=np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def _distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = np.sort(code)
    if not len(code):
        return code, code
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.diff(np.append(first, len(code)))


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


SURVEYED = "block long, kind int, prefix long, lows array<int>, words array<binary>, n array<long>"


def survey(blocks: DataFrame, buckets: int, order: int = ORDER) -> DataFrame:
    """What each block holds: its distinct grams by prefix, and its distinct words by bucket, with their training counts."""

    def of_block(block: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, counts, words = [], [], Counter()
        for data in parts:
            rows = _unpack(data)
            learned = [t for _, learns, t in rows if learns]
            for code, n in [_distinct(gram_codes(learned, order)), (_distinct(gram_codes([t for _, learns, t in rows if not learns], order))[0], None)]:
                codes.append(code)
                counts.append(np.zeros(len(code), dtype=np.int64) if n is None else n)
            for text in learned:
                words.update(text.split())
            for _, learns, text in rows:
                if not learns:
                    for w in text.split():
                        words.setdefault(w, 0)
        code, n = _merge(codes, counts)
        prefix = code >> _LOW
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        size = len(first)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(size, block)), pa.array(np.zeros(size, dtype=np.int32)), pa.array(prefix[first]), _lists((code & ((1 << _LOW) - 1)).astype(np.int32), first, pa.int32()),
            pa.nulls(size, pa.list_(pa.binary())), _lists(n, first, pa.int64()),
        ], names=["block", "kind", "prefix", "lows", "words", "n"])
        by: dict[int, tuple[list, list]] = {}
        for w, k in words.items():
            one = by.setdefault(zlib.crc32(w) % buckets, ([], []))
            one[0].append(w)
            one[1].append(k)
        words.clear()
        size = len(by)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(size, block)), pa.array(np.ones(size, dtype=np.int32)), pa.array(list(by), pa.int64()), pa.nulls(size, pa.list_(pa.int32())),
            pa.array([x[0] for x in by.values()], pa.list_(pa.binary())), pa.array([x[1] for x in by.values()], pa.list_(pa.int64())),
        ], names=["block", "kind", "prefix", "lows", "words", "n"])

    def run(table: pa.Table) -> pa.Table:
        (block,) = set(table.column("block").to_pylist())
        return pa.Table.from_batches(list(of_block(block, table.column("data").to_pylist())))

    return blocks.groupBy("block").applyInArrow(run, SURVEYED)


# ---- the trie's probabilities ----

class Nodes:
    """Counts of the grams of one length, and of the contexts that they follow."""

    def __init__(self, code: np.ndarray, n: np.ndarray, shorter: Nodes | None):
        self.code, self.n = code, n
        context = code >> 8
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else np.zeros(0, dtype=np.int64)
        self.context = context[first]
        self.total = np.add.reduceat(n, first) if len(code) else n
        self.kinds = np.diff(np.append(first, len(code)))
        # what the bytes seen here count one context shorter: they are excluded there
        below = np.zeros(len(code), dtype=np.int64) if shorter is None else shorter.count(code & shorter.mask)
        self.below = np.add.reduceat(below, first) if len(code) else n

    mask = 0

    def count(self, code: np.ndarray) -> np.ndarray:
        at, found = _find(self.code, code)
        return np.where(found, self.n[at], 0) if len(self.n) else np.zeros(len(code), dtype=np.int64)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def shorten(code: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams cut to their last ``size`` bytes."""

    return _merge([code & ((1 << (8 * size)) - 1)], [n])


def trie(code: np.ndarray, n: np.ndarray, order: int, given: list[tuple[np.ndarray, np.ndarray]]) -> list[Nodes]:
    """Nodes of the grams of 1 to ``order + 1`` bytes; the shortest come from ``given``, the others from the grams."""

    out: list[Nodes] = []
    for size in range(1, order + 2):
        node = Nodes(*(given[size - 1] if size <= len(given) else shorten(code, n, size)), out[-1] if out else None)
        node.mask = (1 << (8 * size)) - 1
        out.append(node)
    return out


def log_probabilities(wanted: np.ndarray, nodes: list[Nodes]) -> np.ndarray:
    """log10 probability of each gram's last byte after the bytes before it."""

    out, done = np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
    excluded, ruled_out = np.zeros(len(wanted)), np.zeros(len(wanted))
    for node in reversed(nodes):
        gram = wanted & node.mask
        at, seen = _find(node.context, gram >> 8)
        if not len(node.context):
            continue
        total = np.where(seen, node.total[at], 0) - excluded
        kinds = np.where(seen, node.kinds[at], 0) - ruled_out
        n = node.count(gram)
        live = seen & ~done & (kinds > 0)
        hit, escape = live & (n > 0), live & (n == 0)
        out[hit] += np.log10((2 * n[hit] - 1) / (2 * total[hit]))
        out[escape] += np.log10(kinds[escape] / (2 * total[escape]))
        done |= hit
        excluded = np.where(seen, node.below[at], excluded)
        ruled_out = np.where(seen, node.kinds[at], ruled_out)
    out[~done] -= np.log10(SYMBOLS - ruled_out[~done])
    return out


def model(surveyed: DataFrame, order: int = ORDER) -> DataFrame:
    """(prefix, lows, values) of every gram of the corpus: log10 probabilities by the counts of all training texts."""

    flat = surveyed.filter("kind = 0").select("prefix", F.explode(F.arrays_zip("lows", "n")).alias("g")).select("prefix", "g.lows", "g.n")
    gram = F.shiftleft("prefix", _LOW).bitwiseOR(F.col("lows").cast("long")).alias("gram")
    counts = materialize(flat.select(gram, "n").groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")

    given = []
    for size in (1, 2):  # at most 257 and 257 x 257 rows, whatever the corpus
        rows = counts.filter("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * size)) - 1)).alias("g")).agg(F.sum("n").alias("n")).collect()
        rows = sorted((r["g"], r["n"]) for r in rows)
        given.append((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)))

    def of_context(table: pa.Table) -> pa.Table:
        code, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        by = np.argsort(code)
        code, n = code[by], n[by]
        learned = n > 0
        value = log_probabilities(code, trie(code[learned], n[learned], order, given))
        return pa.table({"gram": code, "value": value})

    # the two bytes before the last one: all contexts of two and more bytes that back off to each other meet
    near = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("near")
    valued = counts.select("gram", "n", near).groupBy("near").applyInArrow(of_context, "gram long, value double")
    packed = valued.select(F.shiftright("gram", _LOW).alias("prefix"), F.struct(F.col("gram").bitwiseAND(F.lit((1 << _LOW) - 1)).cast("int").alias("low"), F.col("value")).alias("g"))
    return materialize(packed.groupBy("prefix").agg(F.sort_array(F.collect_list("g")).alias("g")).select("prefix", F.col("g.low").alias("known"), F.col("g.value").alias("values")), "ppm-model")


def _own_grams(batches):
    """Values of the grams that a block asked for, out of all that share the prefix."""

    for batch in batches:
        if not batch.num_rows:
            continue
        lows, known = batch.column("lows"), batch.column("known")
        row = lambda a: np.repeat(np.arange(len(a), dtype=np.int64), np.diff(a.offsets.to_numpy())) << _LOW
        flat = lambda a: a.flatten().to_numpy()
        values = flat(batch.column("values"))[np.searchsorted(row(known) | flat(known), row(lows) | flat(lows))]
        size = np.diff(lows.offsets.to_numpy())
        starts = np.cumsum(np.append(0, size))[:-1]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("prefix"), _lists(flat(lows), starts, pa.int32()), _lists(values, starts, pa.float64())], names=["block", "prefix", "lows", "values"])


def word_counts(surveyed: DataFrame) -> DataFrame:
    """Per block and bucket: the words and their counts in all training texts; per bucket, how many words were seen and counted.

    A word is in a bucket once per block, so a bucket's size follows the blocks, however frequent its words.
    """

    def of_bucket(table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        words, n = table.column("words").to_pylist(), table.column("n").to_pylist()
        for ws, ks in zip(words, n, strict=True):
            for w, k in zip(ws, ks, strict=True):
                total[w] += k
        seen, counted = sum(k > 0 for k in total.values()), sum(total.values())
        first = [True] + [False] * (len(words) - 1)
        return pa.table({
            "block": table.column("block"), "words": pa.array(words, pa.list_(pa.binary())), "n": pa.array([[total[w] for w in ws] for ws in words], pa.list_(pa.int64())),
            "seen": pa.array([seen * f for f in first], pa.int64()), "counted": pa.array([counted * f for f in first], pa.int64()),
        })

    return surveyed.filter("kind = 1").select("prefix", "block", "words", "n").groupBy("prefix").applyInArrow(of_bucket, "block long, words array<binary>, n array<long>, seen long, counted long")


# ---- scoring ----

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


_PARTS = "block long, kind int, prefix long, lows array<int>, values array<double>, words array<binary>, n array<long>, data binary"


class _Block:
    """Values of a block's grams and words, taken in part by part: grams in rising order, then words, then texts."""

    def __init__(self, totals: tuple[int, int, int], order: int):
        self.order, self.parts, self.words = order, [], {}
        self.tokens, distinct, self.ends = totals
        self.scale, self.of_end = np.log10(self.tokens + distinct + 1), np.log10(self.ends + 1)
        self.code = self.value = None

    def add_grams(self, prefix: np.ndarray, lows: pa.ListArray, values: pa.ListArray) -> None:
        code = np.repeat(prefix, lows.value_lengths().to_numpy()) << _LOW
        code |= lows.flatten().to_numpy()
        self.parts.append((code, values.flatten().to_numpy().copy()))

    def add_words(self, words: list[list[bytes]], n: list[list[int]]) -> None:
        for ws, ks in zip(words, n, strict=True):
            self.words.update(zip(ws, ks, strict=True))

    def score(self, data: bytes) -> pa.RecordBatch:
        if self.code is None:
            none = [(np.zeros(0, dtype=np.int64), np.zeros(0))]
            self.code, self.value = (np.concatenate([p[k] for p in none + self.parts]) for k in (0, 1))
            self.parts = []
        rows = _unpack(data)
        texts = [t for _, _, t in rows]
        length = np.array([len(t) + 1 for t in texts])
        scores = np.add.reduceat(self.value[np.searchsorted(self.code, gram_codes(texts, self.order))], np.cumsum(length) - length)
        out: list[list] = [[] for _ in range(5)]
        for doc_id, learns, text in rows:
            n = np.array([self.words[w] for w in text.split()], dtype=np.float64)
            out[0].append(doc_id)
            out[1].append(not learns)
            out[2].append(len(n) + 1)
            out[3].append(int((n > 0).sum()) + (self.ends > 0))
            out[4].append(float(np.log10(n + 1).sum() + self.of_end - (len(n) + 1) * self.scale))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
        doc_id, held, n_tokens, n_known, base = (pa.array(x, t) for x, t in zip(out, kinds, strict=True))
        return pa.RecordBatch.from_arrays([doc_id, held, n_tokens, n_known, pa.array([self.tokens] * len(rows), pa.int64()), base, pa.array(scores)], names=[c.split()[0] for c in SCORED.split(", ")])


def _score_parts(totals: tuple[int, int, int], order: int):
    """Scores blocks whose rows come sorted by (block, kind, prefix); totals: training tokens, distinct ones, training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if block[a] != number:
                    number, held = block[a], _Block(totals, order)
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.add_grams(part.column("prefix").to_numpy(), part.column("lows"), part.column("values"))
                elif kind[a] == 1:
                    held.add_words(part.column("words").to_pylist(), part.column("n").to_pylist())
                else:
                    for data in part.column("data"):
                        yield held.score(data.as_py())

    return run


def score(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are one end and nothing else.  Rows with equal ids or texts are scored and
    learned from one by one; a null doc_id is learned from.  Without training texts every byte has
    probability 1/257 and the base score is 0.  Further columns are not read; no rows give none.
    """

    if not 2 <= order <= 6:
        raise ValueError("the order lies between 2 and 6")
    blocks = materialize(pack_blocks(docs, block_bytes), "ppm-blocks")
    totals = blocks.select(F.count_distinct("block").alias("blocks")).first()
    surveyed = materialize(survey(blocks, 16 * max(1, totals["blocks"]), order), "ppm-survey")
    counted = materialize(word_counts(surveyed), "ppm-words")
    row = counted.agg(F.sum("seen").alias("seen"), F.sum("counted").alias("counted")).first()
    ends = docs.filter(~held_out(F.col("doc_id"))).count()
    known = ((row["counted"] or 0) + ends, (row["seen"] or 0) + (ends > 0), ends)
    asked = surveyed.filter("kind = 0").select("block", "prefix", "lows").join(model(surveyed, order), "prefix").select("block", "prefix", "lows", "known", "values")
    own = asked.mapInArrow(_own_grams, "block long, prefix long, lows array<int>, values array<double>")
    names = [c.rsplit(" ", 1) for c in _PARTS.split(", ")]

    def part(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in names])

    # one stream per block, its grams sorted by Spark, so that a task holds them once and its texts one step at a time
    parts = part(own, 0).unionByName(part(counted.select("block", "words", "n"), 1)).unionByName(part(blocks, 2))
    return parts.repartition("block").sortWithinPartitions("block", "kind", "prefix").mapInArrow(_score_parts(known, order), SCORED)
