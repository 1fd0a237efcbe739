"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.session import materialize

#: Bytes that separate words: space and U+0009 to U+000D, which is also what ``bytes.split()`` cuts at.
BLANKS = b" \t\n\x0b\x0c\r"

#: Rows that a task handles at a time, and the text bytes after which it stops adding rows.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8, cut at ASCII white space only; null has none."""

    return utf8(text).split()


def utf8(text: str | None) -> bytes:
    """A text's bytes; null counts as empty, a lone surrogate as U+FFFD."""

    return b"" if text is None else text.encode("utf-8", "replace")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold few rows and few text bytes, so that one task's memory stays bounded."""

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or total + n > limit):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, start: Callable[[], Callable] | None = None) -> DataFrame:
    """Applies fn to bounded slices of every partition.

    With ``start``, each task calls it once and uses what it returns in place of fn, for state such as caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start() if start else fn
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def rows_hash(text: str = "text"):
    """A row's text as one number, to tell rows with equal ids apart."""

    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


__all__ = ["BLANKS", "map_slices", "materialize", "rows_hash", "slices", "table", "utf8", "words"]
