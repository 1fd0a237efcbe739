"""Scorecards as machine-readable files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tollway.session import scratch_path


def write_scorecard(card: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines or Parquet; one row per policy."""

    if fmt not in ("json", "parquet"):
        raise ValueError(f"unsupported scorecard format {fmt!r}")
    card.coalesce(1).write.format(fmt).option("ignoreNullFields", False).mode("errorifexists").save(path)


def round_trip(card: DataFrame, fmt: str = "json") -> DataFrame:
    """Writes a card to the shared folder and reads it back with its own schema."""

    path = scratch_path(card.sparkSession, "scorecard")
    write_scorecard(card, path, fmt)
    return card.sparkSession.read.format(fmt).schema(card.schema).load(path)
