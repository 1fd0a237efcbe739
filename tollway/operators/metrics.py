"""Scores and cost reports over query results; each is one map-side combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollway.functions.sizing import small_copy
from tollway.schema import COST_SUM

TOLERANCE = 1e-12
# Policies x tiers x domains of one report.
MAX_REPORT_ROWS = 100_000


def _mean(total: Column, count: Column) -> Column:
    return total.cast("double") / count.cast("double")


def tier_scores(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean quality per policy and tier, null unless every query is feasible."""

    keys = ["policy", *(by or []), "tier"]
    n = F.count(F.lit(1))
    failed = F.count_if(~F.col("feasible"))
    return results.groupBy(*keys).agg(
        F.first("tier_pos").alias("tier_pos"),
        F.first("weight").alias("weight"),
        n.alias("n_queries"),
        failed.alias("n_failed"),
        F.when(failed == 0, _mean(F.sum("quality"), n)).alias("mean_quality"),
        F.sum("cost").cast(COST_SUM).alias("spent"),
        F.count_if(~F.col("within_budget")).alias("over_budget_calls"),
    )


def weighted_quality(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weighted mean over tiers; a null tier makes it null, weights are never shared out."""

    keys = ["policy", *(by or [])]
    complete = F.count("mean_quality") == F.count(F.lit(1))
    value = F.sum(F.col("weight") * F.col("mean_quality")) / F.sum("weight")
    return scores.groupBy(*keys).agg(
        F.when(complete, value).alias("weighted_quality"),
        F.sum("n_queries").alias("n_queries"),
        F.sum("n_failed").alias("n_failed"),
        F.bool_and(F.col("n_failed") == 0).alias("feasible"),
        F.sum("spent").cast(COST_SUM).alias("total_cost"),
    )


def align(scores: DataFrame, by: list[str] | None = None, cheapest: str = "always-cheapest", oracle: str = "oracle") -> DataFrame:
    """Each policy's tiers next to the cheapest and oracle tiers; differing scopes fail.

    A window over the few score rows of a tier, so the results behind them are worked out
    once, not once per side.
    """

    tier = Window.partitionBy(*(by or []), "tier")

    def side(name: str, column: str) -> Column:
        return F.max(F.when(F.col("policy") == name, F.col(column))).over(tier)

    joined = scores.select("policy", *(by or []), "tier", "weight", "n_queries", "mean_quality").withColumns(
        {
            "c_n": side(cheapest, "n_queries"), "c_w": side(cheapest, "weight"), "c_quality": side(cheapest, "mean_quality"),
            "o_n": side(oracle, "n_queries"), "o_w": side(oracle, "weight"), "o_quality": side(oracle, "mean_quality"),
        }
    )
    n, w = F.col("n_queries"), F.col("weight")
    same = (F.col("c_n") == n) & (F.col("o_n") == n) & (F.col("c_w") == w) & (F.col("o_w") == w)
    scope = F.when(~F.coalesce(same, F.lit(False)), F.raise_error(F.lit("reports cover different scopes")))
    return joined.withColumn("mean_quality", F.coalesce(scope.cast("double"), F.col("mean_quality")))


def gap_recovery(scores: DataFrame, by: list[str] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Share of the cheapest-to-oracle gap a policy recovers; may be negative.

    Null when any tier is null or the gap is within the tolerance; an oracle below the
    cheapest or a policy above the oracle is an error in the reports.
    """

    keys = ["policy", *(by or [])]
    r, c, o = F.col("mean_quality"), F.col("c_quality"), F.col("o_quality")
    fault = F.when(o + tolerance < c, F.raise_error(F.lit("oracle quality is below cheapest"))).when(
        r > o + tolerance, F.raise_error(F.lit("policy quality exceeds the oracle"))
    )
    rows = align(scores, by).withColumn("_w", F.coalesce(fault.cast("double"), F.col("weight")))
    full = F.bool_and(r.isNotNull() & c.isNotNull() & o.isNotNull())
    num, den = F.sum(F.col("_w") * (r - c)), F.sum(F.col("_w") * (o - c))
    return rows.groupBy(*keys).agg(
        F.when(full & (F.abs(den) > tolerance), F.try_divide(num, den)).alias("gap_recovery")
    )


def weighted_delta(scores: DataFrame, policy: str, against: str) -> DataFrame:
    """Weighted quality of one policy minus another's; null if either is null."""

    weighted = weighted_quality(scores)
    value = lambda name: F.max(F.when(F.col("policy") == name, F.col("weighted_quality")))
    return weighted.groupBy().agg((value(policy) - value(against)).alias("weighted_delta"))


def quote_error(results: DataFrame) -> DataFrame:
    """Quoted against realized cost per policy and tier, and over all tiers (tier null)."""

    q, r = F.col("quoted"), F.col("cost")
    calls = results.where("call_made").select("policy", "tier", "quoted", "cost", "within_budget")
    sums = calls.groupingSets([["policy", "tier"], ["policy"]], "policy", "tier").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(r == q).alias("exact_calls"),
        F.count_if(r > q).alias("underquoted_calls"),
        F.count_if(r < q).alias("overquoted_calls"),
        F.count_if(~F.col("within_budget")).alias("over_budget_calls"),
        F.sum("quoted").cast(COST_SUM).alias("total_quoted"),
        F.sum("cost").cast(COST_SUM).alias("total_realized"),
        F.sum(F.greatest(r - q, F.lit(0))).cast(COST_SUM).alias("underquoted_amount"),
        F.sum(F.greatest(q - r, F.lit(0))).cast(COST_SUM).alias("overquoted_amount"),
    )
    return with_net_difference(sums).withColumn(
        "absolute_error", (F.col("underquoted_amount") + F.col("overquoted_amount")).cast(COST_SUM)
    )


def with_net_difference(sums: DataFrame) -> DataFrame:
    """Net quote error as a direction and a magnitude."""

    net = F.col("total_realized") - F.col("total_quoted")
    direction = F.when(net > 0, "realized_above_quote").when(net < 0, "realized_below_quote").otherwise("equal")
    return sums.withColumn("net_direction", direction).withColumn("net_amount", F.abs(net).cast(COST_SUM))


def failure_counts(results: DataFrame) -> DataFrame:
    failed = F.count_if(~F.col("feasible"))
    return results.groupBy("policy").agg(
        failed.alias("n_failed"),
        F.bool_and("feasible").alias("feasible"),
        F.count_if(~F.col("call_made")).alias("n_refused"),
    )


def scorecard(results: DataFrame) -> DataFrame:
    """One row per policy: tier qualities, weighted quality, gap recovery, cost, quote error.

    The results shrink to one row per policy and tier first; everything else is computed
    from that small table, so the log is scanned once however many columns there are.
    """

    q, r = F.col("quoted"), F.col("cost")
    n = F.count(F.lit(1))
    failed = F.count_if(~F.col("feasible"))
    made = F.col("call_made")
    sums = results.groupBy("policy", "tier").agg(
        F.first("tier_pos").alias("tier_pos"),
        F.first("weight").alias("weight"),
        n.alias("n_queries"),
        failed.alias("n_failed"),
        F.when(failed == 0, _mean(F.sum("quality"), n)).alias("mean_quality"),
        F.sum("cost").cast(COST_SUM).alias("spent"),
        F.count_if(~F.col("within_budget")).alias("over_budget_calls"),
        F.count_if(made).alias("calls"),
        F.sum("quoted").cast(COST_SUM).alias("total_quoted"),
        F.sum(F.when(made, F.greatest(r - q, F.lit(0)))).cast(COST_SUM).alias("underquoted_amount"),
        F.sum(F.when(made, F.greatest(q - r, F.lit(0)))).cast(COST_SUM).alias("overquoted_amount"),
    )
    small = small_copy(sums, MAX_REPORT_ROWS, "policy and tier rows")
    overall = with_net_difference(
        small.groupBy("policy").agg(
            *[F.max(F.when(F.col("tier") == t, F.col("mean_quality"))).alias(f"{t}_quality") for t in ("fast", "balanced", "premium")],
            F.sum("calls").alias("calls"),
            F.sum("total_quoted").cast(COST_SUM).alias("total_quoted"),
            F.sum("spent").cast(COST_SUM).alias("total_realized"),
            F.sum("underquoted_amount").cast(COST_SUM).alias("underquoted_amount"),
            F.sum("overquoted_amount").cast(COST_SUM).alias("overquoted_amount"),
        )
    ).withColumn("absolute_error", (F.col("underquoted_amount") + F.col("overquoted_amount")).cast(COST_SUM))
    return (
        overall.drop("total_quoted", "total_realized")
        .join(weighted_quality(small), "policy")
        .join(gap_recovery(small), "policy")
    )


def held_out_scores(results: DataFrame) -> DataFrame:
    """Per held-out domain: tier means, weighted quality and gap recovery."""

    scores = tier_scores(results.withColumn("held_out", F.col("domain")), ["held_out"])
    small = small_copy(scores, MAX_REPORT_ROWS, "policy, domain and tier rows")
    tiers = small.groupBy("policy", "held_out").agg(
        *[F.max(F.when(F.col("tier") == t, F.col("mean_quality"))).alias(f"{t}_quality") for t in ("fast", "balanced", "premium")]
    )
    return tiers.join(
        weighted_quality(small, ["held_out"]).select("policy", "held_out", "weighted_quality"), ["policy", "held_out"]
    ).join(gap_recovery(small, ["held_out"]), ["policy", "held_out"])


def paired_delta(card: DataFrame, left: str, right: str, keys: list[str] | None = None) -> DataFrame:
    """Right minus left for every score column; null if either side is null, no winner named."""

    measures = ["fast_quality", "balanced_quality", "premium_quality", "weighted_quality", "gap_recovery"]
    def of(name: str, measure: str) -> Column:
        return F.max(F.when(F.col("policy") == name, F.col(measure)))

    pairs = card.where(F.col("policy").isin(left, right)).groupBy(*(keys or []))
    return pairs.agg(*[(of(right, m) - of(left, m)).alias(f"delta_{m}") for m in measures])


def oracle_violations(results: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Queries on which a policy beats the per-query oracle, or the oracle itself failed."""

    query = Window.partitionBy("tier", "example_id")  # one row per policy
    is_oracle = F.col("policy") == "oracle"
    rows = results.select("policy", "tier", "example_id", "feasible", "quality").withColumns(
        {
            "oracle_quality": F.max(F.when(is_oracle, F.col("quality"))).over(query),
            "oracle_feasible": F.max(F.when(is_oracle, F.col("feasible"))).over(query),
        }
    )
    over = F.col("feasible") & (F.col("quality").cast("double") > F.col("oracle_quality").cast("double") + tolerance)
    return rows.where(~F.col("oracle_feasible") | over).select("policy", "tier", "example_id", "quality", "oracle_quality")


def running_retention(steps: DataFrame, keys: list[str], order: str, bounds: list[float] | None = None) -> DataFrame:
    """Running cost, quality and oracle quality, and their ratio (null on a zero oracle sum).

    ``steps`` has realized, quality and oracle_quality.
    """

    from tollway.operators.prefix import running_totals

    out = running_totals(
        steps,
        keys,
        order,
        {
            "running_cost": F.col("realized").cast(COST_SUM),
            "running_quality": F.col("quality").cast("decimal(32,12)"),
            "running_oracle": F.col("oracle_quality").cast("decimal(32,12)"),
        },
        bounds,
    )
    return out.withColumn(
        "retention",
        F.try_divide(F.col("running_quality").cast("double"), F.col("running_oracle").cast("double")),
    )
