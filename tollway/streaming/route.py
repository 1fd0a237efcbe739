"""Choosing models for a stream of prompts."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tollway.plans.route import route
from tollway.schema import TierSpec
from tollway.sources import artifacts
from tollway.sources.embeddings import Embedded

RELEASES = "release bigint, path string"


def start_routing(decisions: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends the decisions of a routed stream to Parquet.

    ``decisions`` comes from :func:`tollway.plans.route.route` on a streaming table; that
    plan is narrow, so it needs no watermark and no state.
    """

    writer = decisions.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def routed(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession, releases: str, path: str) -> int:
    """Makes the predictor and policy saved under ``path`` the ones for all later micro-batches."""

    latest = current_release(spark, releases)
    number = latest[0] + 1 if latest else 1
    spark.createDataFrame([(number, path)], RELEASES).coalesce(1).write.mode("errorifexists").parquet(f"{releases}/release={number}")
    return number


def current_release(spark: SparkSession, releases: str) -> tuple[int, str] | None:
    """The number and the path of the latest release."""

    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(releases)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    # each release is one row; the folder's own column would hide the number in it
    rows = spark.read.schema(RELEASES).option("recursiveFileLookup", "true").parquet(releases)
    found = rows.agg(F.max(F.struct("release", "path")).alias("r")).first()["r"]
    return (found["release"], found["path"]) if found else None


@dataclass
class FittedRouting:
    """Routes a stream by the released predictor and lambdas, which may be exchanged while it runs.

    Each micro-batch asks for the latest release and writes its decisions, with the release's number, to a folder of
    its own, so a batch that is repeated after a failure replaces its rows.  A predictor is loaded, and
    compared with the vectors' identity, once per release.
    """

    releases: str
    catalogue: dict[str, Decimal]
    tiers: list[TierSpec]
    path: str
    keep: list[str] = field(default_factory=list)
    embedded: Embedded | None = None
    _loaded: tuple | None = None

    def _latest(self, spark: SparkSession) -> tuple:
        found = current_release(spark, self.releases)
        if found is None:
            raise ValueError("no predictor has been released")
        if self._loaded is None or self._loaded[0] != found[0]:
            identity = self.embedded.identity if self.embedded else None
            predictor = artifacts.load_predictor(spark, f"{found[1]}/predictor", identity)
            lambdas, meta = artifacts.load_policy(spark, f"{found[1]}/policy")
            if meta["predictor_identity"] != artifacts.predictor_identity(spark, f"{found[1]}/predictor"):
                raise ValueError("the policy was tuned with another predictor")
            if [r["tier"] for r in meta["tiers"]] != [t.tier for t in self.tiers]:
                raise ValueError("the policy was tuned for other tiers")
            self._loaded = (found[0], predictor, lambdas)
        return self._loaded

    def process(self, batch: DataFrame, epoch: int) -> None:
        number, predictor, lambdas = self._latest(batch.sparkSession)
        chosen = route(batch, self.catalogue, self.tiers, lambdas, predictor.scorer, predictor.calibrators, self.keep, embedded=self.embedded)
        chosen.withColumn("release", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def start(self, prompts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = prompts.writeStream.foreachBatch(lambda df, epoch: self.process(df, epoch))
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def decisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("epoch")
