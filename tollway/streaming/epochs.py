"""State tables of a micro-batch job, one version per epoch in the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EpochTables:
    """Tables written as ``root/name/epoch=N``.

    An epoch reads version N - 1 and writes version N in whole, so an epoch repeated
    after a failure writes the same files again and nothing is counted twice.
    """

    root: str

    def path(self, name: str, epoch: int) -> str:
        return f"{self.root}/{name}/epoch={epoch}"

    def write(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, epoch))
        return df.sparkSession.read.schema(df.schema).parquet(self.path(name, epoch))

    def read(self, spark: SparkSession, name: str, epoch: int, schema: str) -> DataFrame:
        """Version ``epoch``; empty before the first one."""

        if epoch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path(name, epoch))

    def read_all(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """All epochs of an append-only output."""

        return spark.read.schema(schema).parquet(f"{self.root}/{name}").drop("epoch")
