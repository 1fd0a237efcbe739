"""Replay logs derived from the given tables, in Spark and as SQL text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.catalog.registry import table
from tollway.schema import COST, MODEL_STRUCT, QUALITY, TierSpec
from tollway.session import spread

# The derived view's catalogue (model, rank, quote in millionths, base quality).
CATALOGUE = (
    ("m1", 1, 100000, 350),
    ("m2", 2, 200000, 450),
    ("m3", 3, 450000, 550),
    ("m4", 4, 800000, 620),
    ("m5", 5, 1000000, 680),
)
MODEL_IDS = tuple(c[0] for c in CATALOGUE)
CHEAPEST, PREMIUM = "m1", "m5"
DENSE_BUDGETS = {"fast": 350000, "balanced": 700000, "premium": 1200000}
TIGHT_BUDGETS = {"fast": 205000, "balanced": 460000, "premium": 1050000}
WEIGHTS = {"fast": 0.5, "balanced": 0.3, "premium": 0.2}


def tiers(budgets: dict[str, int] = DENSE_BUDGETS) -> list[TierSpec]:
    return [TierSpec(t, Decimal(b) / 1000000, WEIGHTS[t]) for t, b in budgets.items()]


def _draw(key: Column, model: str, kind: str) -> Column:
    text = F.concat(key.cast("string"), F.lit(f":{model}:{kind}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def sample_models(doc_id: Column, n_chars: Column) -> Column:
    """Five candidates per document with hashed charges and qualities."""

    one_micro, one_milli = F.lit(Decimal("0.000001")), F.lit(Decimal("0.001"))
    out = []
    for model, rank, quoted, base in CATALOGUE:
        realized = F.floor((F.lit(quoted) * (850 + _draw(doc_id, model, "c") % 301)) / 1000)
        reach = F.floor(F.least(F.lit(200), F.floor(n_chars / 100)) * (5 - rank) / 10)
        quality = F.greatest(F.lit(0), F.least(F.lit(1000), base + _draw(doc_id, model, "q") % 321) - reach)
        out.append(
            F.struct(
                F.lit(model).alias("model_id"),
                F.lit(Decimal(quoted) / 1000000).cast(COST).alias("quoted"),
                (realized.cast("decimal(16,0)") * one_micro).cast(COST).alias("realized"),
                (quality.cast("decimal(8,0)") * one_milli).cast(QUALITY).alias("quality"),
            )
        )
    return F.array(*out).cast("array<" + MODEL_STRUCT.simpleString() + ">")


def dense_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one prompt; its language is the fold, its source the visible tag."""

    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").cast("string").alias("example_id"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("prompt"),
        F.col("lang").alias("domain"),
        F.col("source").alias("observable_tag"),
        sample_models(F.col("doc_id"), F.col("n_chars")).alias("models"),
    )


def long_tables(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The log as examples, candidates and outcomes."""

    examples = log.select("example_id", "ord", "prompt", "domain", "observable_tag")
    pairs = log.select("example_id", F.explode("models").alias("m"))
    candidates = pairs.select("example_id", "m.model_id", F.col("m.quoted").alias("quoted_cost"))
    outcomes = pairs.select(
        "example_id", "m.model_id", F.col("m.realized").alias("realized_cost"), F.col("m.quality").alias("quality")
    )
    return examples, candidates, outcomes


def predicted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense log with scores that SQL can reproduce: a hash-blurred copy of the quality."""

    log = dense_log(spark, sf_dir)
    scores = [
        (F.element_at("models", i + 1)["quality"] * 1000).cast("bigint") * 500000
        + (_draw(F.col("ord"), m, "p") % 501) * 1000000
        for i, m in enumerate(MODEL_IDS)
    ]
    return log.withColumn("predicted", F.array(*scores))


_VALUES = ", ".join(f"('{m}', {r}, {q}, {b})" for m, r, q, b in CATALOGUE)


def tier_values(budgets: dict[str, int]) -> str:
    return ", ".join(
        f"('{t}', {pos}, {b}, {WEIGHTS[t]}::DOUBLE)" for pos, (t, b) in enumerate(budgets.items())
    )


def sql_log(budgets: dict[str, int] = DENSE_BUDGETS) -> str:
    """Common table expressions: cat, tiers, long (document x model) and lt (x tier)."""

    def h(kind: str) -> str:
        return f"('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':' || c.model_id || ':{kind}'), 1, 8))::BIGINT"

    return f"""cat(model_id, rk, quoted, base) AS (VALUES {_VALUES}),
tiers(tier, tier_pos, budget, weight) AS (VALUES {tier_values(budgets)}),
long AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS example_id, d.doc_id AS ord, d.text AS prompt, d.lang AS domain,
         d.source AS tag, c.model_id, c.rk, CAST(c.quoted AS BIGINT) AS quoted,
         CAST(c.quoted * (850 + {h('c')} % 301) // 1000 AS BIGINT) AS realized,
         CAST(greatest(0, least(1000, c.base + {h('q')} % 321)
              - least(200, d.n_chars // 100) * (5 - c.rk) // 10) AS BIGINT) AS q,
         {h('p')} % 501 AS blur
  FROM documents d CROSS JOIN cat c),
lt AS (SELECT * FROM long CROSS JOIN tiers)"""
