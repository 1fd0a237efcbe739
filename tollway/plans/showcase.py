"""Step-by-step view of learned decisions next to the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators.metrics import running_retention
from tollway.plans.benchmark import Benchmark


def stream_steps(bench: Benchmark, assignments: DataFrame, policy: str | None = None) -> DataFrame:
    """One step per (step, example_id, tier): decision, oracle, running cost and retention.

    Both sides come from the one replay of the benchmark, so they cover the same scope; a
    step without a feasible learned and oracle call is an error.
    """

    name = policy or bench.names[0]
    scope = bench.results.where(F.col("policy").isin(name, "oracle")).join(assignments, ["example_id", "tier"])
    mine = F.col("policy") == name
    pick = lambda c: F.max(F.when(mine, F.col(c)))
    best = lambda c: F.max(F.when(~mine, F.col(c)))
    paired = scope.groupBy("step", "example_id", "tier", "domain").agg(
        F.max("budget").alias("budget"),
        pick("selected_model_id").alias("selected_model_id"), pick("quoted").alias("quoted"), pick("cost").alias("realized"),
        pick("predicted_nano").alias("predicted_nano"), pick("quality").alias("quality"),
        best("selected_model_id").alias("oracle_model_id"), best("cost").alias("oracle_realized"), best("quality").alias("oracle_quality"),
    )
    lost = F.col("quality").isNull() | F.col("oracle_quality").isNull()
    checked = paired.withColumn(
        "quality", F.when(lost, F.raise_error(F.lit("a step has no feasible call")).cast("decimal(20,12)")).otherwise(F.col("quality"))
    )
    return running_retention(checked.withColumn("stream", F.lit(0)), ["stream"], "step").drop("stream")
