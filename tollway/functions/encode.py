"""Numeric feature rows shared by every fit context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.functions.surface import TAGS, with_surface

CONTINUOUS = ("log_char", "log_word", "log_line")
BINARY = ("has_code", "has_math")
SURFACE_WIDTH = len(CONTINUOUS) + len(BINARY) + len(TAGS)
FEATURE_NAMES = (*CONTINUOUS, *BINARY, *[f"domain:{t}" for t in TAGS])
FIRST_TAG = len(CONTINUOUS) + len(BINARY)


def raw_vector(embedding: Column | None = None) -> Column:
    """Three logs, two flags, one column per tag, then the embedding if there is one.

    Needs the columns of :func:`with_surface`.  Nothing here is fitted, so one table
    serves all folds; scaling is derived later from each fold's training moments.
    """

    surface = F.array(
        F.log1p(F.col("n_char").cast("double")),
        F.log1p(F.col("n_word").cast("double")),
        F.log1p(F.col("n_line").cast("double")),
        F.col("has_code").cast("double"),
        F.col("has_math").cast("double"),
        *[F.array_contains("tags", t).cast("double") for t in TAGS],
    )
    if embedding is None:
        return surface
    return F.concat(surface, embedding.cast("array<double>"))


def with_features(log: DataFrame, embedding: str | None = None, width: int = 0) -> DataFrame:
    """Adds ``x``; fails on an embedding of the wrong width or with a non-finite entry.

    Rows without ``prompt`` bring the columns of :func:`with_surface` themselves.
    """

    rows = with_surface(log) if "prompt" in log.columns else log
    if embedding is None:
        return rows.withColumn("x", raw_vector())
    e = F.col(embedding)
    bad = F.size(e) != width
    bad = bad | F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    checked = F.when(
        e.isNull() | bad, F.raise_error(F.lit("embedding has the wrong width or a non-finite entry"))
    ).otherwise(e)
    return rows.withColumn("x", raw_vector(checked))


def fit_schema(features: DataFrame, keys: list[str]) -> DataFrame:
    """Means, population scales (zero becomes one) and sorted tags per fit context.

    Takes training rows only, one per (context, example).
    """

    logs = {name: F.log1p(F.col(src).cast("double")) for name, src in zip(CONTINUOUS, ("n_char", "n_word", "n_line"))}
    present = [F.when(F.max(F.array_contains("tags", t)), F.lit(t)) for t in TAGS]
    scales = [F.stddev_pop(c) for c in logs.values()]
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array(*[F.avg(c) for c in logs.values()]).alias("means"),
        F.array(*[F.when(s > 0, s).otherwise(1.0) for s in scales]).alias("scales"),
        F.array_compact(F.array(*present)).alias("tag_list"),
    )


def encode_rows(features: DataFrame, schema: DataFrame, keys: list[str], embedding: str | None = None) -> DataFrame:
    """Scaled rows for one fit context; ``schema`` has one row per context."""

    rows = features.join(schema, keys)
    logs = [F.log1p(F.col(c).cast("double")) for c in ("n_char", "n_word", "n_line")]
    scaled = [
        (v - F.element_at("means", i + 1)) / F.element_at("scales", i + 1) for i, v in enumerate(logs)
    ]
    vector = F.concat(
        F.array(*scaled, F.col("has_code").cast("double"), F.col("has_math").cast("double")),
        F.transform("tag_list", lambda t: F.array_contains(F.col("tags"), t).cast("double")),
    )
    if embedding is not None:
        vector = F.concat(vector, F.col(embedding).cast("array<double>"))
    return rows.withColumn("encoded", vector)
