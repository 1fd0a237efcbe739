"""Token ids as ORC files: sorted stripes, run-length coded integers, row indexes and Bloom filters on ids.

Documents are dealt out by ranges of ``doc_id`` and sorted, so every file and every stripe holds one
narrow range of ids; footers, row indexes and Bloom filters then let a reader skip stripes, and Spark
reads stripes in parallel.  The ids come from the tokenizers library, which a worker asks once per
distinct word.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollway.llm.common import map_slices, rows_hash
from tollway.session import scratch_path

#: ORC writer settings: index entries every 2,000 rows, 16 MB stripes, zstd streams, v2 run lengths.
WRITER = {
    "orc.create.index": "true", "orc.row.index.stride": "2000", "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd",
}


@cache
def library(path: str):
    """The tokenizer of a file, with truncation and padding off."""

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Words whose ids a worker remembers from task to task; beyond that it starts afresh.
REMEMBERED = 900_000
#: Texts whose characters all come before this one are cut into words here; others go to the library whole.
LATIN_END = "\u0180"


def _latin_words() -> re.Pattern:
    """The tokenizer's own cut of a normal text, for Latin characters: contractions, letters, single digits, other runs."""

    of = lambda kind: "".join(re.escape(chr(c)) for c in range(ord(LATIN_END)) if unicodedata.category(chr(c))[0] == kind)
    letters, numbers, blanks = of("L"), of("N"), r"\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}{blanks}]+")


_LATIN = _latin_words()


class Ids:
    """Ids of texts as little-endian bytes, from the tokenizers library.

    The library is asked for many new words in one call.  The last token of a word, and no other, spells
    the end of a word, so the ids of a call fall apart into words again.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        with open(path, encoding="utf-8") as f:
            end = json.load(f)["model"]["end_of_word_suffix"]
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(end) for i in range(self.tokenizer.get_vocab_size())])
        self.words: dict[str, bytes] = {}

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def add(self, new: list[str]) -> None:
        parts = [new[i : i + 4000] for i in range(0, len(new), 4000)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<i4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                self.words.update((w, self.alone(w)) for w in part)
                continue
            flat = ids.tobytes()
            self.words.update(zip(part, [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null has none."""

        cut: list[list[str]] = []
        whole: dict[int, str] = {}
        for i, text in enumerate(texts):
            if not text or text.isascii() and "<|" not in text:
                cut.append(_LATIN.findall((text or "").lower()))
            elif "<|" not in text and max(normal := unicodedata.normalize("NFC", text)) < LATIN_END:
                cut.append(_LATIN.findall(normal.lower()))
            else:
                cut.append([])
                whole[i] = text
        new = set().union(*cut).difference(self.words)
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = set().union(*cut)
        if new:
            self.add(list(new))
        get = self.words.__getitem__
        return [self.alone(whole[i]) if i in whole else b"".join(map(get, words)) for i, words in enumerate(cut)]


@cache
def ids_of(path: str) -> Ids:
    return Ids(path)


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, tie, ids (with the end id) in the order of the input."""

    def start():
        ids_from = ids_of(path)
        end = np.array([end_id], dtype="<i4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat = [b + end for b in ids_from.encode(batch.column("text").to_pylist())]
            ends = np.cumsum([0, *(len(b) // 4 for b in flat)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), dtype="<i4")))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), ids], names=["doc_id", "tie", "ids"])

        return work

    return map_slices(docs, None, "doc_id long, tie long, ids array<int>", start)


def write(docs: DataFrame, path: str, out: str, end_id: int = 1) -> str:
    """Writes the ids of every text as ORC in ascending doc_id order and returns the folder.

    The texts are shuffled once, by range; their ids never are.  Null ids come first.
    """

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rows_hash().alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = token_rows(ordered, path, end_id)
    rows.withColumn("n_tokens", F.size("ids").cast("long")).write.options(**WRITER).orc(out)
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, tie, ids, n_tokens and the file of each row."""

    frame = spark.read.schema("doc_id long, tie long, ids array<int>, n_tokens long").orc(folder)
    return frame.withColumn("file", F.col("_metadata.file_name"))


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; the filter reaches the stripes' indexes and Bloom filters."""

    return read(spark, folder).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids", "n_tokens")


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        size = pc.list_value_length(ids).to_pylist()
        crc, at = [], 0
        for n in size:
            crc.append(zlib.crc32(flat[at : at + 4 * n]))
            at += 4 * n
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), batch.column("file"), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "tie", "file", "n_tokens", "ids_crc32"],
        )


def layout(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ``start`` counts the ids of all documents before this one: a running total within each file
    plus the totals of the files before it.  Only the files' totals meet in one task.  Rows with equal
    doc_id follow each other in the order of their text's hash; an empty folder gives no rows.
    """

    rows = read(spark, folder).select("doc_id", "tie", "ids", "file").mapInArrow(_checksums, "doc_id long, tie long, file string, n_tokens long, ids_crc32 long")
    sizes = read(spark, folder).groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.struct("doc_id", "tie")).alias("first"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(offsets, "file").select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    return layout(spark, write(docs, path, scratch_path(spark, "orc-tokens"), end_id))
