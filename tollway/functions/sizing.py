"""Size-checked local copies and broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def local_copy(df: DataFrame, limit: int) -> DataFrame | None:
    """The evaluated table as a local one with known size, or None above the limit."""

    held = df.limit(limit + 1).toArrow()
    if held.num_rows > limit:
        return None
    return df.sparkSession.createDataFrame(held, schema=df.schema)


def small_copy(df: DataFrame, limit: int, what: str) -> DataFrame:
    """Local copy of a table that is small by its nature; more rows are an error."""

    held = local_copy(df, limit)
    if held is None:
        raise ValueError(f"more than {limit} {what}")
    return held


def settle(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Evaluates a fitted table once and says whether it is small.

    At most ``limit`` rows come back as a local table with the broadcast hint.  A larger
    table is returned as it was, for an ordinary shuffled join.
    """

    held = local_copy(df, limit)
    return (df, False) if held is None else (F.broadcast(held), True)
