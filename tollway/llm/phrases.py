"""Phrase mining by stripes: each prefix keys an associative counter of the words that follow it.

A stripe is the counter of one prefix of 0 to 3 words: the stripe of no words counts all words of a language, that
of "new york" counts the words after "new york".  Tasks fill stripes for bounded blocks of text and
merge them elementwise over the corpus.  The merged structure holds all that scoring needs: an entry is
a phrase with its count, a prefix's own count is its entry in the shorter stripe, and the largest count among the
entries that extend a phrase, to the right in its own stripe or to the left as the last entry of another
prefix, decides whether a longer phrase subsumes it.

A phrase cannot be more frequent than a part of it, and rare phrases are by far the most.  So before stripes are filled,
phrases are counted as bare hashes, first pairs of frequent words, then longer ones made of frequent pairs: a
block sends six bytes per distinct phrase.  A bitmap of fixed size over the hashes tells what may be
frequent: it may let a rare one through, never hold a frequent one back, and the counts in the stripes are compared
with the limit in the end.  So results do not depend on hashes or on the bitmap's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollway.llm.common import materialize, slices, utf8

LEAST, LONGEST, TOP = 30, 4, 2000
#: Bits of a bitmap of frequent phrases, a power of two.
BITS = 1 << 27
#: Words of the corpus per bucket of hashes, the fewest and the most buckets.
PER_BUCKET, BUCKETS = 1 << 20, (32, 1 << 20)
#: Bits of a hash that are kept beside its bucket.
KEPT = 40
#: Text bytes read at once, and those whose stripes are counted together.
STEP_BYTES, BLOCK_BYTES = 4 << 20, 24 << 20
#: Entries of stripes in one row.
ENTRIES = 2000
#: Groups in which each language's first phrases are found before they meet.
SALTS = 64
_CUT = 0xFF  # never in UTF-8: stands between pieces
_LOWER = bytes(
    _CUT if x in b".,;:!?\n\x0b\x0c\r" else 0x20 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256)
)
STRIPES = "lang string, k int, prefixes array<string>, nexts array<string>, counts array<long>"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_with_cuts(texts: list[str | None]) -> list[bytes]:
    """Words of texts in order, with A-Z lowered; a mark of its own between pieces and between texts."""

    joined = b"\xff".join([utf8(t) for t in texts]).translate(_LOWER)
    return joined.replace(b"\xff", b" \xff ").split()


def hash_word(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode()))


def hash_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash per pair of word hashes, not the same for a pair turned round."""

    mixed = left * _MIX[0] ^ (right + (left >> np.uint64(29))) * _MIX[1]
    return mixed ^ (mixed >> np.uint64(32))


class Bitmap:
    """A set of hashes, told apart by as many of their first bits as a fixed number of bits can."""

    def __init__(self, data: bytes):
        self.octets = np.frombuffer(zlib.decompress(data), dtype=np.uint8)
        self.shift = np.uint64(64 - (8 * len(self.octets)).bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.octets[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Block:
    """Word numbers of the texts of one language, up to a bounded size."""

    def __init__(self, lang: str, words: Bitmap | None):
        self.lang, self.frequent = lang, words
        self.number: dict[bytes, int] = {bytes([_CUT]): 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[str | None]) -> None:
        found = words_with_cuts(texts)
        number = self.number
        for w in set(found).difference(number):
            number[w] = len(number)
        self.parts.append(np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found)))
        self.parts.append(np.zeros(1, dtype=np.int32))
        self.size += sum(len(t) for t in texts if t)

    def take(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words by number, their hashes, and the sequence of numbers; zero stands where no phrase goes on."""

        names = list(self.number)
        hashes = np.array([hash_word(self.lang, w) for w in names], dtype=np.uint64) if self.frequent else np.zeros(0, dtype=np.uint64)
        order = np.concatenate([*self.parts, np.zeros(1, dtype=np.int32)])
        if self.frequent:
            keep = self.frequent.has(hashes)
            keep[0] = False
            order = np.where(keep[order], order, 0)
        return names, hashes, order


def _stripe_rows(lang: str, names: pa.Array, prefixes: list[np.ndarray], nexts: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``ENTRIES`` entries that are sorted by prefix: a stripe's entries stand together, a long stripe goes on."""

    k = len(prefixes)
    for a in range(0, len(nexts), 100 * ENTRIES):
        part = slice(a, min(a + 100 * ENTRIES, len(nexts)))
        size = part.stop - a
        offsets = pa.array([*range(0, size, ENTRIES), size], pa.int32())
        columns = [names.take(pa.array(p[part])) for p in prefixes]
        prefix = pc.binary_join_element_wise(*columns, " ") if k > 1 else columns[0] if k else pa.array([""] * size)
        values = (prefix, names.take(pa.array(nexts[part])), pa.array(counts[part], pa.int64()))
        n = len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([k] * n, pa.int32()), *(pa.ListArray.from_arrays(offsets, v) for v in values)], names=["lang", "k", "prefixes", "nexts", "counts"])


def _count_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs sorted by the left number, their counts, and each given pair's place among them."""

    code, of, n = np.unique((left.astype(np.int64) << 32) | right, return_inverse=True, return_counts=True)
    return (code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32), n, of.astype(np.int32)


def _frequent(order: np.ndarray, hashes: np.ndarray, longest: int, pairs: Bitmap | None, longer: Bitmap | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 2 to ``longest`` words: where phrases begin that the filters let through, and their hashes.

    A longer phrase needs both phrases that are one word shorter.
    """

    at = np.flatnonzero((order[:-1] > 0) & (order[1:] > 0))
    code, keep = hash_pairs(hashes[order[at]], hashes[order[at + 1]]), pairs
    for size in range(2, longest + 1):
        if size > 2:
            begins = np.zeros(len(order) + 1, dtype=bool)
            begins[at] = True
            both = begins[at + 1]
            at, code, keep = at[both], code[both], longer
            code = hash_pairs(code, hashes[order[at + size - 1]])
        if keep is not None:
            passed = keep.has(code)
            at, code = at[passed], code[passed]
        yield size, at, code


def _fill(block: Block, longest: int, pairs: Bitmap | None, longer: Bitmap | None) -> Iterator[pa.RecordBatch]:
    """Stripes of a block: without filters of no words, with filters of one and more words."""

    names, hashes, order = block.take()
    strings = pa.array([b"", *names[1:]], pa.binary()).cast(pa.string())
    if block.frequent is None:
        n = np.bincount(order, minlength=len(names))[1:]
        yield from _stripe_rows(block.lang, strings, [], np.arange(1, len(names), dtype=np.int32), n)
        return
    prefixes: list[np.ndarray] = []
    codes = order.astype(np.int32)  # a number per place for the phrase of one word less that begins there
    for size, at, _ in _frequent(order, hashes, longest, pairs, longer):
        left, right, n, of = _count_pairs(codes[at], order[at + size - 1])
        prefixes = [p[left] for p in prefixes] if size > 2 else [left]
        yield from _stripe_rows(block.lang, strings, prefixes, right, n)
        prefixes = [*prefixes, right]
        codes = np.zeros(len(order), dtype=np.int32)
        codes[at] = of


def _by_block(docs: DataFrame, schema: str, words: bytes | None, others: list[bytes | None], fill, block_bytes: int) -> DataFrame:
    """Applies fill to blocks of the texts of one language; a task holds ``block_bytes`` of text and a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_words, *filters = [Bitmap(x) if x else None for x in (words, *others)]
        held: dict[str, Block] = {}
        for batch in batches:
            for part in slices(batch, limit=STEP_BYTES):
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in set(langs):
                    held.setdefault(lang, Block(lang, of_words)).add([t for x, t in zip(langs, texts, strict=True) if x == lang])
                if sum(b.size for b in held.values()) > block_bytes:
                    for block in held.values():
                        yield from fill(block, *filters)
                    held = {}
        for block in held.values():
            yield from fill(block, *filters)

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, schema)


def stripes(docs: DataFrame, longest: int = LONGEST, words: bytes | None = None, pairs: bytes | None = None, longer: bytes | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stripes (lang, k, prefixes, nexts, counts) of blocks of texts, entry by entry.

    Without filters those of no words; with the bitmap of frequent ``words`` those of 1 to ``longest - 1`` words
    whose entries the filters let through.
    """

    return _by_block(docs, STRIPES, words, [pairs, longer], lambda block, *filters: _fill(block, longest, *filters), block_bytes)


def frequent_hashes(docs: DataFrame, sizes: tuple[int, int], words: bytes, pairs: bytes | None, buckets: int, least: int = LEAST, bits: int = BITS, block_bytes: int = BLOCK_BYTES) -> bytes:
    """Bitmap of the hashes of phrases of so many words, from the first to the last size, that ``least`` phrases share.

    A block sends each bucket of hashes its distinct ones with their counts, up to ``least``; a bucket adds them up
    and gives its stretch of the bitmap.
    """

    width = buckets.bit_length() - 1
    count = np.dtype("u1" if least < 256 else "<u8")

    def pack(block: Block, of_pairs: Bitmap | None) -> Iterator[pa.RecordBatch]:
        _, hashes, order = block.take()
        for size, _, code in _frequent(order, hashes, sizes[1], of_pairs, None):
            if size < sizes[0] or not len(code):
                continue
            code, n = np.unique(code >> np.uint64(64 - KEPT - width), return_counts=True)
            bucket = (code >> np.uint64(KEPT)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rest = code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT // 8]
            n = np.minimum(n, least).astype(count)
            ends = [*first[1:].tolist(), len(code)]
            data = [rest[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(data, pa.binary())], names=["bucket", "data"])

    def add_up(table: pa.Table) -> pa.Table:
        each = KEPT // 8 + count.itemsize
        codes, counts = [], []
        for data in table.column("data"):
            raw = np.frombuffer(data.as_py(), dtype=np.uint8)
            n = len(raw) // each
            wide = np.zeros((n, 8), dtype=np.uint8)
            wide[:, : KEPT // 8] = raw[: n * (KEPT // 8)].reshape(n, -1)
            codes.append(wide.view("<u8").ravel())
            counts.append(raw[n * (KEPT // 8) :].view(count).astype(np.int64))
        code, n = np.concatenate(codes), np.concatenate(counts)
        by = np.argsort(code)
        code, n = code[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        found = code[first][np.add.reduceat(n, first) >= least]
        at = found >> np.uint64(KEPT - (bits // buckets).bit_length() + 1)
        stretch = np.zeros(bits // buckets, dtype=np.uint8)
        stretch[at.astype(np.int64)] = 1
        return pa.table({"bucket": table.column("bucket")[:1], "octets": pa.array([np.packbits(stretch, bitorder="little").tobytes()], pa.binary())})

    packed = _by_block(docs, "bucket long, data binary", words, [pairs], pack, block_bytes)
    summed = packed.groupBy("bucket").applyInArrow(add_up, "bucket long, octets binary")
    octets, size = bytearray(bits // 8), bits // buckets // 8
    for row in summed.toLocalIterator():  # bits / 8 bytes in all, whatever the corpus
        octets[row["bucket"] * size : (row["bucket"] + 1) * size] = row["octets"]
    return zlib.compress(bytes(octets), 1)


def merge(parts: DataFrame, least: int = 1) -> DataFrame:
    """Elementwise sum of stripes, one row per entry (lang, prefix, k, next, n), of those that reach ``least``.

    A row per entry, so that the stripe of a common prefix is never held by one task.
    """

    entries = parts.select("lang", "k", F.explode(F.arrays_zip("prefixes", "nexts", "counts")).alias("e"))
    return entries.groupBy("lang", F.col("e.prefixes").alias("prefix"), "k", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("n")).filter(F.col("n") >= least)


def word_bitmap(words: DataFrame, bits: int = BITS) -> bytes:
    """The hashes of words (lang, next) as a compressed bitmap."""

    size = 1 << 15  # bits of a chunk, as bitmap_construct_agg makes them
    shift = np.uint64(64 - bits.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = batch.column("lang").to_pylist(), batch.column("next").to_pylist()
            places = np.array([hash_word(x, w.encode()) for x, w in zip(langs, found, strict=True)], dtype=np.uint64) >> shift
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64))], names=["place"])

    places = words.select("lang", "next").mapInArrow(run, "place long")
    chunks = places.groupBy(F.shiftright("place", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(size - 1))).alias("set"))
    octets = bytearray(max(bits, size) // 8)
    for row in chunks.toLocalIterator():  # bits / 8 bytes in all, whatever the corpus
        octets[row["chunk"] * size // 8 : (row["chunk"] + 1) * size // 8] = row["set"]
    return zlib.compress(bytes(octets[: bits // 8]), 1)


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Merged stripes (lang, phrase, prefix, k, next, n) of all phrases that reach ``least``; and n of all words per language."""

    words = materialize(merge(stripes(docs, block_bytes=block_bytes)), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n_words"))
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = min(max(BUCKETS[0], 1 << (total // PER_BUCKET).bit_length()), BUCKETS[1], bits // 8)
    entries = words.filter(F.col("n") >= least)
    if longest > 1:
        of_words = word_bitmap(entries, bits)
        pairs = frequent_hashes(docs, (2, 2), of_words, None, buckets, least, bits, block_bytes)
        longer = frequent_hashes(docs, (3, longest), of_words, pairs, buckets, least, bits, block_bytes) if longest > 2 else None
        entries = entries.unionByName(merge(stripes(docs, longest, of_words, pairs, longer, block_bytes), least))
    phrase = F.when(F.col("k") == 0, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return materialize(entries.select("lang", phrase.alias("phrase"), "prefix", "k", "next", "n"), "stripes"), totals


def _words(phrase, n):
    """The first n words of a phrase, or the last -n."""

    return F.call_function("substring_index", phrase, F.lit(" "), n.cast("int"))


def _suffix(phrase):
    """A phrase without its first word."""

    return phrase.substr(F.instr(phrase, " ") + 1, F.length(phrase))


def score(entries: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Candidates (lang, phrase, a, l, r, score) by their lowest cut, without those that a longer one subsumes."""

    phrase = F.col("phrase")
    candidates = entries.filter("k > 0").select("lang", "phrase", "k", F.col("n").alias("a"))
    # a longer phrase that subsumes one holds an extension by one word that does: its count is no smaller
    longer = candidates.filter("k > 1")
    inner = longer.select("lang", F.explode(F.array(_words(phrase, F.col("k")), _suffix(phrase))).alias("phrase"), "a")
    widest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("widest"))
    free = candidates.join(widest, ["lang", "phrase"], "left").filter((F.col("widest") * 100 < F.col("a") * 80) | F.col("widest").isNull())
    # each cut takes the first k words and the rest
    first, rest = _words(phrase, F.col("cut")), _words(phrase, F.col("cut") - F.col("k") - 1)
    cuts = free.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("cut")).select("lang", "phrase", "a", "cut", first.alias("left"), rest.alias("right"))
    # a common first word is a hot key of these joins: adaptive execution splits its rows, each has one partner
    counts = entries.select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    value = F.expr("CAST((CAST(a AS DECIMAL(19, 0)) * 2000000) DIV (CAST(l AS DECIMAL(19, 0)) + r) AS BIGINT)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(value.alias("score"), "cut", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score", F.col("m.cut").alias("cut"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score.

    Null texts count as empty, a null lang as ``und``; empty and blank texts have no words.  Rows
    with equal ids or texts count one by one; ids and further columns are not read.  Ties in score go by count, then
    by the phrase's bytes.  A very long text is cut into words whole; no rows give none.
    """

    entries, totals = count_phrases(docs, least, longest, bits, block_bytes)
    scored = materialize(score(entries, longest), "phrases")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    named = ranked.join(totals, "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")
