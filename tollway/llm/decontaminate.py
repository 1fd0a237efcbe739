"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the word n-grams of the test items that the corpus' own word shares make unlikely, by one
limit for a corpus of any size; a frequent passage thus keeps its seeds however often it was copied.
Of short items all n-grams are seeds.  A document and an item that share a seed are aligned locally,
word by word, around the shared seeds; the score is the best alignment's as a share of what a whole
copy of the item scores.

Items are aligned once per different text, and found texts are joined back to the items that have them.
The seeds go to the tasks with the job.  Texts are taken in passes of about ``PASS_BYTES``, so this stays
bounded for a test collection of any size and for items that repeat.  Nothing is shuffled but word counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.common import map_slices, utf8

PASS_BYTES = 8 << 20
_MIX = np.int64(0x1E3779B97F4A7C15)  # any odd number with mixed bits
_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)).lower() + bytes(range(128, 256))


@dataclass(frozen=True)
class Match:
    """Seed length in words, least surprise of a seed in bits, words from which an item does without its common
    n-grams, alignment scores and the least share of a whole copy's score."""

    seed_words: int = 3
    seed_bits: float = 27.0
    long_item: int = 20
    hit: int = 2
    miss: int = -1
    gap: int = -1
    least_score: float = 0.5


def fold(text: str | None) -> list[bytes]:
    """Words in lower case; ASCII punctuation separates."""

    return utf8(text).translate(_FOLD).split()


@dataclass
class Items:
    """Test items as word numbers, with their seeds sorted by code."""

    ids: list
    words: dict[bytes, int]
    sequences: list[np.ndarray]
    codes: np.ndarray | None = None
    item_of: np.ndarray | None = None
    offset_of: np.ndarray | None = None
    seed_words: int = 0
    short: dict[tuple, list[int]] | None = None


def read_items(rows: list) -> Items:
    words: dict[bytes, int] = {}
    ids, sequences = [], []
    for item_id, text in rows:
        found = fold(text)
        if found:
            ids.append(item_id)
            sequences.append(np.array([words.setdefault(w, len(words)) for w in found], dtype=np.int64))
    return Items(ids, words, sequences)


def numbered(raw: list[bytes], items: Items) -> np.ndarray:
    get = items.words.get
    return np.array([get(w, -1) for w in raw], dtype=np.int64)


def word_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """How often the corpus has each word of the items, and all its words: at most one number per word of a pass."""

    def run(batches):
        counts, total = np.zeros(len(items.words) + 1, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = numbered(fold(text), items)
                counts += np.bincount(found + 1, minlength=len(counts))
                total += len(found)
        at = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at]), pa.array([total, *counts[1:][at]])], names=["word", "n"])

    out, total = np.zeros(len(items.words)), 0
    for row in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        if row["word"] < 0:
            total = row["n"]
        else:
            out[row["word"]] = row["n"]
    return out, total


def gram_codes(words: np.ndarray, k: int) -> np.ndarray:
    """A number for the k words from each place on; different n-grams with one number cost an alignment, no result."""

    n = len(words) - k + 1
    code = np.zeros(n, dtype=np.int64)
    for j in range(k):
        code = (code ^ words[j : j + n]) * _MIX  # wraps round at 64 bits
        code ^= code >> 29
    return code


def add_seeds(items: Items, counts: np.ndarray, total: int, match: Match) -> Items:
    """Seeds of each item: n-grams with a surprise of ``seed_bits``, and the less likely half of all in any case.

    Of items below ``long_item`` words every n-gram is a seed; one shorter than a seed is a seed as a whole.
    """

    k = match.seed_words
    bits = -np.log2(np.maximum(counts, 1) / max(total, 1))
    codes, owner, offset = [], [], []
    items.short = defaultdict(list)
    for i, words in enumerate(items.sequences):
        if len(words) < k:
            items.short[tuple(words.tolist())].append(i)
            continue
        n = len(words) - k + 1
        surprise = sum(bits[words[j : j + n]] for j in range(k))
        rare = np.arange(n)
        if len(words) >= match.long_item:
            rare = np.union1d(np.flatnonzero(surprise >= match.seed_bits), np.argsort(-surprise, kind="stable")[: (n + 1) // 2])
        codes.append(gram_codes(words, k)[rare])
        owner.append(np.full(len(rare), i))
        offset.append(rare)
    flat = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (codes, owner, offset)]
    order = np.argsort(flat[0], kind="stable")
    items.codes, items.item_of, items.offset_of = (x[order] for x in flat)
    items.seed_words = k
    items.short = dict(items.short)
    return items


def align(item: np.ndarray, region: np.ndarray, match: Match) -> tuple[int, int]:
    """Best local alignment's score and the place in the region at which it ends."""

    steps = np.arange(len(region) + 1)
    above = np.zeros(len(region) + 1, dtype=np.int64)
    best = end = 0
    for word in item:
        row = np.maximum(above + match.gap, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(region == word, match.hit, match.miss))
        above = np.maximum.accumulate(row - match.gap * steps) + match.gap * steps  # gaps along the region
        if (top := int(above.max())) > best:
            best, end = top, int(above.argmax())
    return best, end


def found_in(words: np.ndarray, items: Items, match: Match) -> Iterator[tuple[int, float, int]]:
    """(item, score, word at which the copy ends) of every item that a document holds."""

    k = items.seed_words
    if items.short:
        for size in {len(s) for s in items.short}:
            for at in range(len(words) - size + 1):
                for i in items.short.get(tuple(words[at : at + size].tolist()), ()):
                    yield i, 1.0, at + size
    if len(words) < k or not len(items.codes):
        return
    n = len(words) - k + 1
    known = words >= 0
    whole = np.logical_and.reduce([known[j : j + n] for j in range(k)])
    at = np.flatnonzero(whole)
    if not len(at):
        return
    code = gram_codes(words, k)[at]
    low, high = np.searchsorted(items.codes, code), np.searchsorted(items.codes, code, side="right")
    hits = defaultdict(list)
    for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
        for s in range(a, b):
            hits[int(items.item_of[s])].append(p - int(items.offset_of[s]))
    for i, starts in hits.items():
        item = items.sequences[i]
        slack = len(item) // 4 + 3
        best = (0.0, 0)
        begin = stop = None
        for start in [*sorted(set(starts)), None]:
            if begin is not None and (start is None or start - slack > stop):
                score, end = align(item, words[begin:stop], match)
                best = max(best, (score / (match.hit * len(item)), begin + end))
                begin = None
            if start is not None:
                if begin is None:
                    begin = max(0, start - slack)
                stop = start + len(item) + slack
        if best[0] >= match.least_score:
            yield i, best[0], best[1]


def text_key() -> F.Column:
    return F.sha2(F.col("text"), 256).alias("key")


def item_passes(docs: DataFrame, items: DataFrame, match: Match) -> Iterator[Items]:
    """Different item texts by their keys, with seeds, some ``PASS_BYTES`` of text at a time."""

    rows = items.filter(F.col("text").isNotNull()).select(text_key(), "text").dropDuplicates(["key"])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(1.25 * size / PASS_BYTES))
    for k in range(passes):
        part = rows if passes == 1 else rows.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == k)
        found = read_items([(r["key"], r["text"]) for r in part.toLocalIterator()])
        if found.ids:
            yield add_seeds(found, *word_counts(docs, found), match)


def contaminated(docs: DataFrame, items: DataFrame, match: Match = Match()) -> DataFrame:
    """(doc_id, item_id, score, end_word) of every document that holds a copy of an item, also an edited one.

    Null and empty texts, and items without words, match nothing.  Items with equal texts are
    all reported; rows with equal doc_id are looked at one by one; no items or no documents give no rows.
    ``end_word`` is the number of the document's words up to the end of the copy.
    """

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, key string, score double, end_word long"

    def one(known: Items) -> DataFrame:
        names = pa.array(known.ids)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, item, score, end = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                best: dict[int, tuple[float, int]] = {}
                for i, s, e in found_in(numbered(fold(text), known), known, match):
                    best[i] = max(best.get(i, (0.0, 0)), (s, e))
                for i, (s, e) in best.items():
                    doc.append(doc_id)
                    item.append(i)
                    score.append(s)
                    end.append(e)
            chosen = names.take(pa.array(item, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), chosen, pa.array(score, pa.float64()), pa.array(end, pa.int64())], names=["doc_id", "key", "score", "end_word"])

        return map_slices(rows, work, schema)

    parts = [one(known) for known in item_passes(rows, items, match)]
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return found.join(items.select("item_id", text_key()), "key").select("doc_id", "item_id", "score", "end_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, match: Match = Match()) -> DataFrame:
    """The documents that hold no copy of any item, with all their columns."""

    def clean(known: Items):
        @F.pandas_udf("boolean")
        def test(text: pd.Series) -> pd.Series:
            return pd.Series([next(found_in(numbered(fold(t), known), known, match), None) is None for t in text], dtype=bool)

        return test(F.col("text"))

    return reduce(lambda out, known: out.filter(clean(known)), item_passes(docs, items, match), docs)
