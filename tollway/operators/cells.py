"""Rows with equal features folded into cells, the unit all fitting works on.

A fitted score depends on a row only through its features, and a choice only through
features and quotes.  So rows that share domain, quotes and features are added up once
(one shuffle with map-side combine, safe for hot cells), and every fit, calibration and
lambda search reads cells.  Where no two rows agree, cells are simply the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.schema import TierSpec

# Up to this many models the sums are plain columns of one aggregate.
WIDE_MODELS = 64


def cells(features: DataFrame, tiers: list[TierSpec], n_models: int) -> DataFrame:
    """(domain, quotes, x) with row count and per-model sums.

    ``over`` counts, per tier and model, the rows whose charge exceeds the tier's budget.
    """

    keyed = features.select(
        "domain", F.transform("models", lambda m: m["quoted"]).alias("quotes"), "x", "models"
    )
    keys = ["domain", "quotes", "x"]
    if n_models <= WIDE_MODELS:
        at = [F.element_at("models", i + 1) for i in range(n_models)]
        over = [
            F.array(*[F.count_if(m["realized"] > F.lit(t.budget)) for m in at]) for t in tiers
        ]
        return keyed.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(m["quality"]) for m in at]).alias("sum_q"),
            F.array(*[F.sum(m["realized"]) for m in at]).alias("sum_c"),
            F.array(*over).alias("over"),
        )
    long = keyed.select(*keys, F.posexplode("models").alias("pos", "m"))
    per_model = long.groupBy(*keys, "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("m.quality").alias("q"),
        F.sum("m.realized").alias("c"),
        F.array(*[F.count_if(F.col("m.realized") > F.lit(t.budget)) for t in tiers]).alias("o"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "q", "c", "o")))
    packed = per_model.groupBy(*keys).agg(F.first("n").alias("n"), ordered.alias("p"))

    def tier_counts(i: int) -> Column:
        return F.transform("p", lambda e: e["o"][i])

    return packed.select(
        *keys, "n", F.col("p.q").alias("sum_q"), F.col("p.c").alias("sum_c"),
        F.array(*[tier_counts(i) for i in range(len(tiers))]).alias("over"),
    )
