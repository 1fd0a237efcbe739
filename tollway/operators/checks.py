"""Violation tables: empty when the data is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.schema import COST_SUM, MAX_MODELS_PER_EXAMPLE


def require_empty(violations: DataFrame, message: str) -> None:
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def catalogue_overflow(models: DataFrame, limit: int = MAX_MODELS_PER_EXAMPLE) -> DataFrame:
    """Examples with more candidates than a catalogue may have."""

    return models.groupBy("example_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing from, or extra in, the second table.

    One shuffle: both sides are tagged, put together and counted per key.
    """

    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(
        actual.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("a"))
    )
    seen = both.groupBy(*keys).agg(F.max("e").alias("e"), F.max("a").alias("a"))
    return seen.where("e <> a").select(*keys, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("problem"))


def replay_violations(examples: DataFrame, candidates: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Everything that makes a log unfit for replay, as (example_id, problem) rows."""

    def named(df: DataFrame, problem: str) -> DataFrame:
        return df.select("example_id", F.lit(problem).alias("problem"))

    pairs = ["example_id", "model_id"]
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    parts = [
        named(duplicate_keys(examples, ["example_id"]), "duplicate example"),
        named(duplicate_keys(candidates, pairs), "duplicate candidate"),
        named(duplicate_keys(outcomes, pairs), "duplicate outcome"),
        named(catalogue_overflow(candidates), "too many candidates"),
        named(examples.where(blank("example_id") | blank("prompt") | blank("domain")), "empty text"),
        named(outcomes.where(blank("model_id")), "empty model"),
        named(outcomes.where("realized_cost is null or realized_cost < 0"), "bad realized cost"),
        named(candidates.where("quoted_cost is null or quoted_cost < 0"), "bad quoted cost"),
        named(outcomes.where("quality is null"), "bad quality"),
        coverage(candidates, outcomes, pairs).select("example_id", F.concat_ws(" ", "problem", F.lit("outcome")).alias("problem")),
        named(coverage(examples, candidates.select("example_id").distinct(), ["example_id"]), "example without candidates or the reverse"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stable_catalogue(log: DataFrame) -> DataFrame:
    """Per model: quote range and in how many rows it occurs; stable when all rows agree."""

    n_examples = log.count()
    per_model = log.select(F.explode("models").alias("m")).groupBy(F.col("m.model_id").alias("model_id")).agg(
        F.min("m.quoted").alias("min_quote"), F.max("m.quoted").alias("max_quote"), F.count(F.lit(1)).alias("n_rows")
    )
    return per_model.withColumn(
        "stable", (F.col("min_quote") == F.col("max_quote")) & (F.col("n_rows") == F.lit(n_examples))
    )


def catalogue(log: DataFrame) -> list[tuple[str, object]]:
    """(model, quote) pairs of a stable catalogue, by model; fails if any row differs."""

    rows = stable_catalogue(log).limit(MAX_MODELS_PER_EXAMPLE + 1).collect()
    if not rows:
        raise ValueError("the log has no rows")
    if len(rows) > MAX_MODELS_PER_EXAMPLE or not all(r["stable"] for r in rows):
        raise ValueError("models and quotes must be the same in every example")
    return sorted((r["model_id"], r["min_quote"]) for r in rows)


def roles(log: DataFrame) -> DataFrame:
    """Cheapest and dearest model of the catalogue."""

    models = log.select(F.explode("models").alias("m")).select("m.model_id", "m.quoted").distinct()
    key = F.struct("quoted", "model_id")
    return models.agg(F.min(key)["model_id"].alias("cheapest"), F.max(key)["model_id"].alias("premium"))


def quote_underruns(log: DataFrame) -> DataFrame:
    """Charges above their quote."""

    return log.select("example_id", F.explode("models").alias("m")).where("m.realized > m.quoted").select(
        "example_id", "m.model_id", "m.quoted", "m.realized"
    )


def report_violations(results: DataFrame) -> DataFrame:
    """Tiers whose calls, charges and budgets do not add up."""

    call_cost = F.when(F.col("call_made"), F.col("cost")).otherwise(0)
    recount = F.col("call_made") & (F.col("cost") > F.col("remaining_before"))
    sums = results.groupBy("policy", "tier").agg(
        F.sum("cost").cast(COST_SUM).alias("spent"),
        F.sum(call_cost).cast(COST_SUM).alias("call_spend"),
        F.count_if(~F.col("within_budget")).alias("over_flagged"),
        F.count_if(recount).alias("over_counted"),
        F.count_if(F.col("feasible") & F.col("quality").isNull()).alias("no_quality"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("example_id").alias("n_ids"),
    )
    bad = (
        (F.col("spent") != F.col("call_spend"))
        | (F.col("over_flagged") != F.col("over_counted"))
        | (F.col("no_quality") > 0)
        | (F.col("n") != F.col("n_ids"))
    )
    return sums.where(bad)


def decision_check(decision: Column, candidates: Column, remaining: Column) -> Column:
    """Why a decision must be refused, or null."""

    hit = F.try_element_at(F.filter(candidates, lambda m: m["model_id"] == decision), F.lit(1))
    return (
        F.when(decision.isNull(), "nothing affordable")
        .when(hit.isNull(), "unknown model")
        .when(hit["quoted"] > remaining, "quote above what is left")
    )
