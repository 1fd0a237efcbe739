"""Per-tag best model, fitted without the evaluated fold's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.functions.sizing import settle
from tollway.operators.policies import affordable_both
from tollway.schema import TIERS, TierSpec, with_literals, with_tiers


def fit(log: DataFrame, tiers: list[TierSpec], domains: list[str]) -> DataFrame:
    """Rows (held_out, tier, tag, model_id, mean_quality, mean_cost, n).

    Sums are made once per (domain, tier, tag, model); a fold's training sums are the
    totals minus the fold's own share, so no row is read once per fold.
    """

    tagged = with_tiers(log.where(F.col("observable_tag").isNotNull()), tiers)
    fits = tagged.withColumn("m", F.explode(affordable_both(F.col("models"), F.col("budget"))))
    own = fits.groupBy("domain", "tier", F.col("observable_tag").alias("tag"), F.col("m.model_id").alias("model_id")).agg(
        F.sum("m.quality").alias("q"), F.sum("m.realized").alias("c"), F.count(F.lit(1)).alias("n")
    )
    total = own.groupBy("tier", "tag", "model_id").agg(
        F.sum("q").alias("tq"), F.sum("c").alias("tc"), F.sum("n").alias("tn")
    )
    folds = with_literals(total, "held_out", domains)
    mine = own.withColumnRenamed("domain", "held_out")
    left = folds.join(mine, ["held_out", "tier", "tag", "model_id"], "left").select(
        "held_out", "tier", "tag", "model_id",
        (F.col("tq") - F.coalesce("q", F.lit(0))).alias("q"),
        (F.col("tc") - F.coalesce("c", F.lit(0))).alias("c"),
        (F.col("tn") - F.coalesce("n", F.lit(0))).alias("n"),
    ).where("n > 0")
    # Means as decimals: equal means stay equal, so the next key decides.
    mean_q = (F.col("q").cast("decimal(26,12)") / F.col("n").cast("decimal(12,0)"))
    mean_c = (F.col("c").cast("decimal(26,12)") / F.col("n").cast("decimal(12,0)"))
    ranked = left.withColumns({"_mq": mean_q, "_mc": mean_c})
    best = F.min(F.struct((-F.col("_mq")).alias("a"), F.col("_mc").alias("b"), F.col("model_id").alias("model_id"), F.col("n").alias("n"), F.col("q").alias("q"), F.col("c").alias("c")))
    picked = ranked.groupBy("held_out", "tier", "tag").agg(best.alias("_b"))
    return picked.select(
        "held_out", "tier", "tag", F.col("_b.model_id").alias("model_id"),
        (-F.col("_b.a")).cast("double").alias("mean_quality"),
        F.col("_b.b").cast("double").alias("mean_cost"), F.col("_b.n").alias("n"),
        F.col("_b.q").alias("quality_sum"), F.col("_b.c").alias("cost_sum"),
    )


def attach(log: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``_table`` (tier to model) for each row's fold and tag."""

    entries = [v for t in TIERS for v in (F.lit(t), F.max(F.when(F.col("tier") == t, F.col("model_id"))))]
    wide = table.groupBy("held_out", "tag").agg(F.create_map(*entries).alias("_table"))
    lookup, _ = settle(wide)
    same = (F.col("domain") == F.col("held_out")) & (F.col("observable_tag") == F.col("tag"))
    return log.join(lookup, same, "left").drop("held_out", "tag")


def evidence(log: DataFrame, table: DataFrame, domains: list[str], fallback_id: str) -> DataFrame:
    """Per outer fold: member counts, number of fitted entries, fallback model."""

    per_domain = log.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    sizes = with_literals(per_domain, "held_out", domains).groupBy("held_out").agg(
        F.sum(F.when(F.col("domain") != F.col("held_out"), F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("domain") == F.col("held_out"), F.col("n")).otherwise(0)).alias("n_test"),
    )
    entries = table.groupBy("held_out").agg(F.count(F.lit(1)).alias("n_entries"))
    return sizes.join(entries, "held_out", "left").select(
        "held_out", "n_train", "n_test",
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.lit(fallback_id).alias("fallback_model_id"),
    )
