"""Quality rules by distribution divergence, beside a few counting rules.

Each language has a reference: the shares of character classes and of its commonest words over all
its documents.  A document's own shares are compared with those by Jensen-Shannon distance (base 2,
0 to 1).  Short texts have noisy shares, so each comparison has a least length and a limit that is
wider for fewer words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollway.llm.common import BLANKS, map_slices, materialize, utf8

SYMBOLS = b"#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "blank", "stop", "symbol", "accented", "other"]
#: Counters of a task are handed on when they hold so many words.
HELD = 400_000


@dataclass(frozen=True)
class Rules:
    """Limits.  A document fails a comparison if its distance is over ``limit + slack / sqrt(n)``."""

    least_words: int = 50
    repeat_percent: int = 50
    common_words: int = 64
    class_least_bytes: int = 200
    class_limit: float = 0.18
    class_slack: float = 0.6
    word_least_words: int = 100
    word_limit: float = 0.2
    word_slack: float = 2.2
    reference_least_words: int = 2000


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"))
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", BLANKS), ("stop", b".,;:!?'\"()-"), ("accented", range(0xC2, 0xC5)), ("other", range(0xC5, 0x100))):
        out[list(chars)] = CLASSES.index(name)
    out[0x80:0xC0] = len(CLASSES)  # bytes that go on with a character
    return out


_TABLE = _class_table().astype(np.uint8)


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(raw, dtype=np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, each with a sum over 0."""

    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""

    inside = raw.translate(None, BLANKS)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    repeated = 0
    if len(words) > 3:
        second, third = words[1:], words[2:]
        seen = Counter(zip(words, second, third))
        if len(seen) < len(words) - 2:
            hit = np.fromiter((seen[w] > 1 for w in zip(words, second, third)), dtype=bool, count=len(words) - 2)
            covered = np.zeros(len(words), dtype=bool)
            for k in range(3):
                covered[k : k + len(hit)] |= hit
            repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


@dataclass
class Reference:
    """Character-class counts of a language, and the places of its common words with their counts (the last bin: all others)."""

    classes: np.ndarray
    places: dict[bytes, int] = field(default_factory=dict)
    words: np.ndarray = field(default_factory=lambda: np.zeros(1))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n) over all documents: kind ``c`` counts character classes, ``w`` words in lower case.

    Tasks count in memory and hand on what they hold whenever it grows past ``HELD`` words.
    """

    def run(batches):
        def rows(held):
            lang, kind, key, n = [], [], [], []
            for name, (classes, seen) in held.items():
                lang += [name] * (len(CLASSES) + len(seen))
                kind += ["c"] * len(CLASSES) + ["w"] * len(seen)
                key += [c.encode() for c in CLASSES] + list(seen.keys())
                n += classes.tolist() + list(seen.values())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], names=["lang", "kind", "key", "n"])

        held: dict = defaultdict(lambda: [np.zeros(len(CLASSES), dtype=np.int64), Counter()])
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = utf8(text)
                one = held[lang or ""]
                one[0] += class_counts(raw)
                one[1].update(raw.lower().split())
            if sum(len(x[1]) for x in held.values()) > HELD:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    found = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, kind string, key binary, n long")
    return found.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, Reference]:
    """A reference per language with at least ``reference_least_words`` words, and "" for all documents together.

    What reaches the driver is one short row per language: eight class counts and ``common_words`` words.
    """

    seen = materialize(corpus_counts(docs), "quality-counts")
    both = seen.unionByName(seen.filter("lang <> ''").withColumn("lang", F.lit(""))).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    total = both.groupBy("lang").agg(F.sum(F.when(F.col("kind") == "w", F.col("n"))).alias("total"))
    total = total.filter((F.col("total") >= rules.reference_least_words) | (F.col("lang") == ""))
    best = both.withColumn("place", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))).filter(F.col("place") <= max(rules.common_words, len(CLASSES)))
    rows = best.join(total, "lang").groupBy("lang").agg(F.first("total").alias("total"), F.collect_list(F.struct("kind", "place", "key", "n")).alias("top"))
    out = {}
    for row in rows.toLocalIterator():
        top = sorted((x for x in row["top"] if x["kind"] == "w" and x["place"] <= rules.common_words), key=lambda x: x["place"])
        by_class = {bytes(x["key"]).decode(): x["n"] for x in row["top"] if x["kind"] == "c"}
        common = [x["n"] for x in top]
        out[row["lang"]] = Reference(
            np.array([by_class.get(c, 0) for c in CLASSES], dtype=float), {bytes(x["key"]): i for i, x in enumerate(top)},
            np.array([*common, (row["total"] or 0) - sum(common)], dtype=float),
        )
    return out


def judge(text: str | None, lang: str | None, known: dict[str, Reference], rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    A distance is null if the text is too short for it or nothing is known of any language.
    """

    raw = utf8(text)
    words = raw.split()
    n = len(words)
    chars, symbols, lines, repeated = counts(raw, words)
    failed = n < rules.least_words or 100 * repeated > rules.repeat_percent * n
    ref = known.get(lang or "") or known.get("")
    of_class = of_word = None
    kept = not failed
    if ref is not None and len(raw) >= rules.class_least_bytes and ref.classes.sum():
        of_class = distance(class_counts(raw), ref.classes)
        kept &= of_class <= rules.class_limit + rules.class_slack / n**0.5 if n else False
    if ref is not None and n >= rules.word_least_words and ref.words.sum():
        own = np.zeros(len(ref.words))
        for w, k in Counter(raw.lower().split()).items():
            own[ref.places.get(w, -1)] += k
        of_word = distance(own, ref.words)
        kept &= of_word <= rules.word_limit + rules.word_slack / n**0.5
    return n, chars, symbols, lines, repeated, failed, bool(kept), of_class, of_word


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, the distances and the verdict of every document.

    Null and empty texts have no words and fail.  A null or rare language is held against all
    documents together.  Equal rows get equal verdicts, further columns are not read, an
    empty table gives no rows.  Two narrow passes over the texts; only word counts are shuffled.
    """

    known = references(docs, rules)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(t, lang, known, rules) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)]
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["doc_id", *_NAMES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return map_slices(rows, work, f"doc_id long, {COLUMNS}")


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns; their rows are judged where they are, without a join."""

    known = references(docs, rules)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([judge(t, lg, known, rules)[6] for t, lg in zip(text, lang, strict=True)], dtype=bool)

    return docs.filter(passes(F.col("text"), F.col("lang").cast("string")))
