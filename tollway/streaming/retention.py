"""Running cost and quality retention over an ordered stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tollway.operators.metrics import running_retention
from tollway.streaming.epochs import EpochTables

TOTALS = "tier string, cost_before decimal(38,12), quality_before decimal(38,12), oracle_before decimal(38,12), last_ord bigint"
OUTPUT = (
    "tier string, ord bigint, running_cost decimal(38,12), running_quality decimal(38,12), "
    "running_oracle decimal(38,12), retention double"
)


@dataclass(frozen=True)
class RetentionStream:
    """Running totals per tier that carry on from epoch to epoch.

    Steps must arrive in order across micro-batches (``ord`` rises from one to the next);
    inside a micro-batch they are ordered here.  A step that is not behind all those of its tier
    before it would get wrong totals and leave wrong ones, so it stops the stream.
    """

    tables: EpochTables

    def process(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        carried = self.tables.read(spark, "totals", epoch - 1, TOTALS)
        late = batch.join(F.broadcast(carried.select("tier", "last_ord")), "tier").where("ord <= last_ord").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")).first()
        if late["n"]:
            raise ValueError(f"{late['n']} steps of epoch {epoch} are out of order, from ord {late['ord']} on")
        local = running_retention(batch, ["tier"], "ord")
        joined = local.join(F.broadcast(carried), "tier", "left")  # one row per tier

        def carry(column: str, base: str):
            return (F.col(column) + F.coalesce(F.col(base), F.lit(0))).cast("decimal(38,12)").alias(column)

        rows = joined.select(
            "tier", "ord", carry("running_cost", "cost_before"), carry("running_quality", "quality_before"),
            carry("running_oracle", "oracle_before"),
        )
        ratio = F.try_divide(F.col("running_quality").cast("double"), F.col("running_oracle").cast("double"))
        out = self.tables.write(rows.withColumn("retention", ratio), "steps", epoch)
        last = out.groupBy("tier").agg(
            F.max("running_cost").alias("c"), F.max_by("running_quality", "ord").alias("q"), F.max_by("running_oracle", "ord").alias("o"), F.max("ord").alias("l")
        )
        merged = carried.join(last, "tier", "full").select(
            "tier", F.coalesce("c", "cost_before").alias("cost_before"), F.coalesce("q", "quality_before").alias("quality_before"),
            F.coalesce("o", "oracle_before").alias("oracle_before"), F.coalesce("l", "last_ord").alias("last_ord"),
        )
        self.tables.write(merged, "totals", epoch)

    def start(self, steps: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = steps.writeStream.foreachBatch(lambda df, epoch: self.process(df, epoch))
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def steps(self, spark: SparkSession) -> DataFrame:
        return self.tables.read_all(spark, "steps", OUTPUT)
