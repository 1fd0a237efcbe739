"""Leave-one-domain-out folds and the training subsets they share."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.schema import MAX_DOMAINS, bounded_values, with_literals


def domain_list(log: DataFrame, column: str = "domain") -> list[str]:
    domains = bounded_values(log, column, MAX_DOMAINS, "domains")
    if len(domains) < 2:
        raise ValueError("leaving one domain out needs at least two domains")
    return domains


def with_folds(df: DataFrame, domains: list[str]) -> DataFrame:
    """Each row once per held-out domain, with its role in that fold.

    Costs a factor of the number of domains; fitted operators use subset sums instead.
    """

    rows = with_literals(df, "held_out", domains)
    return rows.withColumn("role", F.when(F.col("domain") == F.col("held_out"), "test").otherwise("train"))


def fold_violations(folds: DataFrame) -> DataFrame:
    """Folds whose members overlap, whose sides are empty, or whose tests miss rows."""

    per_row = folds.groupBy("held_out", "example_id").agg(F.count_distinct("role").alias("n_roles"))
    overlap = per_row.where("n_roles > 1").groupBy("held_out").count().select(
        "held_out", F.lit("train and test overlap").alias("problem"), F.col("count").alias("n")
    )
    sides = folds.groupBy("held_out").agg(
        F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test")
    )
    empty = sides.where("train = 0 or test = 0").select(
        "held_out", F.lit("empty side").alias("problem"), F.least("train", "test").alias("n")
    )
    tested = folds.groupBy("example_id").agg(F.count_if(F.col("role") == "test").alias("times"))
    uncovered = tested.where("times <> 1").groupBy().count().where("count > 0").select(
        F.lit(None).cast("string").alias("held_out"),
        F.lit("row not tested exactly once").alias("problem"),
        F.col("count").alias("n"),
    )
    return overlap.unionByName(empty).unionByName(uncovered)


@dataclass(frozen=True)
class SubsetPlan:
    """Training subsets, named by the domains they leave out (as a bit mask).

    Omitting up to three domains covers outer fold, inner fold and calibration fold.
    Omitting none is the deployable fit.
    """

    domains: tuple[str, ...]

    def __post_init__(self) -> None:
        if not 2 <= len(self.domains) <= MAX_DOMAINS:
            raise ValueError(f"subset plans need 2 to {MAX_DOMAINS} domains")

    def bit(self, domain: str) -> int:
        return 1 << self.domains.index(domain)

    def masks(self, omitted: int) -> list[int]:
        return [sum(1 << i for i in c) for c in combinations(range(len(self.domains)), omitted)]

    def training_masks(self) -> list[int]:
        """Subsets the nested evaluation trains on."""

        if len(self.domains) < 4:
            raise ValueError("nested evaluation needs at least four domains")
        return [*self.masks(1), *self.masks(2), *self.masks(3)]

    def calibration_masks(self) -> list[int]:
        return [*self.masks(1), *self.masks(2)]

    def excluded(self, mask: int) -> list[str]:
        return [d for i, d in enumerate(self.domains) if mask >> i & 1]

    def counts(self, n_rows: int | None = None) -> dict[str, int]:
        d = len(self.domains)
        out = {
            "subsets": comb(d, 3) + comb(d, 2) + d,
            "score_blocks": 3 * comb(d, 3) + 2 * comb(d, 2) + d,
            "memberships_per_row": comb(d - 1, 2) + (d - 1) + 1,
            "calibrated_fits": d * d,
        }
        if n_rows is not None:
            out["row_memberships"] = n_rows * out["memberships_per_row"]
        return out


def subset_table(spark: SparkSession, plan: SubsetPlan) -> DataFrame:
    """One row per training subset; at most 696 of them."""

    rows = [(m, bin(m).count("1"), plan.excluded(m)) for m in plan.training_masks()]
    return spark.createDataFrame(rows, "mask int, n_omitted int, excluded array<string>")


def score_blocks(log: DataFrame, plan: SubsetPlan) -> DataFrame:
    """Subset and excluded domain pairs with the number of rows each block scores."""

    counts = log.groupBy("domain").agg(F.count(F.lit(1)).alias("n_rows"))
    blocks = subset_table(log.sparkSession, plan).select("mask", "n_omitted", F.explode("excluded").alias("domain"))
    return blocks.join(counts, "domain")
