"""Source-order row numbers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollway.functions.sizing import settle
from tollway.session import materialize

# Offsets, two numbers per scan task, are broadcast up to this many tasks.
MAX_SCAN_TASKS = 500_000


def _with_block(df: DataFrame) -> DataFrame:
    """Adds what a scan says of each row's file and of its split's place in it; without files, empty ones."""

    try:
        return df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")})
    except AnalysisException:
        return df.withColumns({"_file": F.lit(""), "_start": F.lit(0).cast("bigint")})


def with_ord(df: DataFrame, name: str = "ord") -> DataFrame:
    """Adds 0-based numbers in source order, in two passes: by file path, place in the file, and row.

    Scan tasks are packed by size, so their own order tells nothing.  Rows are written once with
    their file, split and scan position; the counts of the splits then give each split's rows their
    offset.  A table that is not read from files is numbered in the order of its partitions.
    """

    placed = materialize(_with_block(df).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    splits = placed.groupBy("_file", "_start", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_start", "_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = splits.select("_file", "_start", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    short, _ = settle(offsets, MAX_SCAN_TASKS)
    return (
        placed.join(short, ["_file", "_start", "_part"])
        .withColumn(name, (F.col("_off") + F.col("_id") - F.col("_first")).cast("bigint"))
        .drop("_file", "_start", "_part", "_off", "_first", "_id")
    )
