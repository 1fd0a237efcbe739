"""Folds, training subsets and score blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.catalog.registry import query
from tollway.catalog.sample import dense_log
from tollway.operators import folds


@query("lodo_folds", "J10", "SELECT h.lang AS held_out, CAST(doc_id AS VARCHAR) AS example_id, CASE WHEN d.lang = h.lang THEN 'test' ELSE 'train' END AS role FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) h")
def lodo_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dense_log(spark, sf_dir)
    return folds.with_folds(log, folds.domain_list(log)).select("held_out", "example_id", "role")


@query("fold_checks", "J14 U4", """SELECT h.lang AS held_out, count(*) FILTER (d.lang <> h.lang) AS n_train, count(*) FILTER (d.lang = h.lang) AS n_test, 0 AS n_problems
FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM documents) h GROUP BY h.lang""")
def fold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dense_log(spark, sf_dir)
    f = folds.with_folds(log, folds.domain_list(log))
    bad = folds.fold_violations(f).groupBy("held_out").agg(F.sum("n").cast("int").alias("bad"))
    sides = f.groupBy("held_out").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))
    return sides.join(bad, "held_out", "left").select("held_out", "n_train", "n_test", F.coalesce("bad", F.lit(0)).alias("n_problems"))


_DOMAINS = """d AS (SELECT lang AS domain, count(*) AS n, CAST(row_number() OVER (ORDER BY lang) - 1 AS INT) AS pos FROM documents GROUP BY lang),
masks AS (SELECT CAST(m AS INT) AS mask FROM range(1, 16) r(m) WHERE bit_count(CAST(m AS INT)) <= 3)"""


@query("training_subsets", "M4 M3", f"""WITH {_DOMAINS}
SELECT mask, CAST(bit_count(mask) AS INT) AS n_omitted, CAST(sum(CASE WHEN (mask >> pos) & 1 = 0 THEN n END) AS BIGINT) AS n_train FROM masks, d GROUP BY mask""")
def training_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All training subsets of the nested evaluation with their row counts."""

    log = dense_log(spark, sf_dir)
    plan = folds.SubsetPlan(tuple(folds.domain_list(log)))
    counts = log.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    subsets = folds.subset_table(spark, plan).withColumn("domain", F.explode(F.array(*[F.lit(d) for d in plan.domains])))
    kept = subsets.where(~F.array_contains("excluded", F.col("domain"))).join(counts, "domain")
    return kept.groupBy("mask", "n_omitted").agg(F.sum("n").alias("n_train"))


@query("score_blocks", "J11 M4", f"WITH {_DOMAINS} SELECT mask, CAST(bit_count(mask) AS INT) AS n_omitted, domain, n AS n_rows FROM masks, d WHERE (mask >> pos) & 1 = 1")
def score_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = dense_log(spark, sf_dir)
    plan = folds.SubsetPlan(tuple(folds.domain_list(log)))
    return folds.score_blocks(log, plan).select("mask", "n_omitted", "domain", "n_rows")


@query("domain_views", "P11 M1", """SELECT f.lang AS fold, d.lang AS domain, count(*) AS n_rows, count(*) AS n_labelled
FROM documents d JOIN (SELECT DISTINCT lang FROM documents) f ON d.lang <> f.lang GROUP BY f.lang, d.lang""")
def domain_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and labels written per domain and read back for the training side of every fold."""

    from tollway.functions.encode import with_features
    from tollway.operators import views

    log = dense_log(spark, sf_dir)
    features = views.by_domain(views.feature_view(with_features(log)), "features-by-domain")
    labels = views.by_domain(views.label_view(log), "labels-by-domain")
    both = features.join(labels.drop("domain"), "example_id", "left")
    counted = both.groupBy("domain").agg(F.count(F.lit(1)).alias("n_rows"), F.count("targets").alias("n_labelled"))
    every = counted.agg(F.collect_list(F.struct("domain", "n_rows", "n_labelled")).alias("d"))  # one entry per domain
    return every.select(F.explode("d.domain").alias("fold"), "d").select("fold", F.inline("d")).where("fold <> domain")
