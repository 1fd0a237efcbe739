"""Column types of the replay log and of the result tables."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COST = T.DecimalType(28, 12)
COST_SUM = T.DecimalType(38, 12)
QUALITY = T.DecimalType(20, 12)

# The three budget tiers, in order.
TIERS = ("fast", "balanced", "premium")

# Sizes that keep driver-side and per-task state bounded; beyond them a job fails
# before it runs instead of growing without limit.
MAX_MODELS_PER_EXAMPLE = 4096
MAX_DOMAINS = 16

MODEL_STRUCT = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("quoted", COST),
        T.StructField("realized", COST),
        T.StructField("quality", QUALITY),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("example_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("observable_tag", T.StringType()),
        T.StructField("models", T.ArrayType(MODEL_STRUCT)),
    ]
)


@dataclass(frozen=True)
class TierSpec:
    """One budget tier: at most three exist, so they travel as literals, not as a table."""

    tier: str
    budget: Decimal
    weight: float

    def __post_init__(self) -> None:
        if self.tier not in TIERS:
            raise ValueError(f"unknown tier {self.tier!r}")
        if self.budget < 0 or not self.budget.is_finite():
            raise ValueError("budget must be finite and non-negative")
        if not 0 < self.weight < float("inf"):
            raise ValueError("tier weight must be positive and finite")


def check_tiers(tiers: list[TierSpec]) -> list[TierSpec]:
    if not tiers:
        raise ValueError("at least one tier is needed")
    if len({t.tier for t in tiers}) != len(tiers):
        raise ValueError("tier values must be unique")
    return list(tiers)


def cost_lit(value: Decimal | int | str) -> Column:
    return F.lit(Decimal(str(value))).cast(COST)


def tiers_array(tiers: list[TierSpec]) -> Column:
    """Tiers as an array literal: exploding it replaces a join with a three-row table."""

    return F.array(
        *[
            F.struct(
                F.lit(t.tier).alias("tier"),
                F.lit(pos).alias("tier_pos"),
                cost_lit(t.budget).alias("budget"),
                F.lit(float(t.weight)).alias("weight"),
            )
            for pos, t in enumerate(check_tiers(tiers))
        ]
    )


def tiers_frame(spark: SparkSession, tiers: list[TierSpec]) -> DataFrame:
    return spark.range(1).select(F.inline(tiers_array(tiers)))


def with_tiers(df: DataFrame, tiers: list[TierSpec]) -> DataFrame:
    """One row per input row and tier; a narrow step, no shuffle."""

    return df.withColumn("_t", F.explode(tiers_array(tiers))).select(
        *df.columns, "_t.tier", "_t.tier_pos", "_t.budget", "_t.weight"
    )


def with_literals(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """One row per input row and value of a short checked list."""

    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def bounded_values(df: DataFrame, column: str, limit: int, what: str) -> list[str]:
    """Distinct values of a column known to be short; fails above the limit."""

    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}")
    return sorted(r[0] for r in rows)
