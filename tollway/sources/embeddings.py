"""Precomputed prompt embeddings."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.functions.surface import with_hash
from tollway.operators import checks

VECTOR_ROWS = "prompt_sha256 string, embedding array<float>"
IDENTITY_ROWS = "identity string"


@dataclass(frozen=True)
class EmbeddingIdentity:
    """What produced the vectors; stored next to a predictor and compared before use."""

    provider: str
    model: str
    revision: str
    pooling: str
    normalize: bool
    manifest_sha256: str
    width: int

    def __post_init__(self) -> None:
        for name in ("provider", "model", "revision", "pooling"):
            value = getattr(self, name)
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"embedding {name} must be a text that is not empty")
        if not isinstance(self.normalize, bool):
            raise ValueError("embedding normalize must be true or false")
        if not isinstance(self.manifest_sha256, str) or not re.fullmatch("[0-9a-f]{64}", self.manifest_sha256):
            raise ValueError("embedding manifest_sha256 must be 64 lowercase hex digits")
        if not isinstance(self.width, int) or isinstance(self.width, bool) or self.width < 1:
            raise ValueError("embedding width must be a positive whole number")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> EmbeddingIdentity:
        found = json.loads(text)
        if not isinstance(found, dict) or set(found) != set(cls.__dataclass_fields__):
            raise ValueError("an embedding identity has exactly the known fields")
        return cls(**found)


@dataclass(frozen=True)
class Embedded:
    """One vector per prompt, by the prompt's hash, and what produced them."""

    identity: EmbeddingIdentity
    vectors: DataFrame


def save(embedded: Embedded, path: str) -> None:
    """Writes vectors (prompt_sha256, embedding) and their identity."""

    embedded.vectors.select("prompt_sha256", "embedding").write.mode("errorifexists").parquet(f"{path}/vectors")
    spark = embedded.vectors.sparkSession
    spark.createDataFrame([(embedded.identity.to_json(),)], IDENTITY_ROWS).write.mode("errorifexists").parquet(f"{path}/identity")


def load(spark: SparkSession, path: str) -> Embedded:
    """Reads saved vectors; fails on repeated prompts, wrong widths and non-finite entries."""

    rows = spark.read.schema(IDENTITY_ROWS).parquet(f"{path}/identity").collect()
    if len(rows) != 1:
        raise ValueError("vectors without one identity")
    identity = EmbeddingIdentity.from_json(rows[0]["identity"])
    vectors = spark.read.schema(VECTOR_ROWS).parquet(f"{path}/vectors")
    checks.require_empty(vector_violations(vectors.withColumnRenamed("prompt_sha256", "example_id"), identity.width), "bad embedding")
    return Embedded(identity, vectors)


def attach_prompts(rows: DataFrame, embedded: Embedded) -> DataFrame:
    """Adds ``embedding`` by the hash of ``prompt``; a prompt without a vector is an error.

    For prompts without a logged outcome as well: nothing but the text names the vector.  Vectors have
    one row per prompt, so a prompt that many rows share is a hot key of the rows' side only, which adaptive
    execution splits.  The join moves the rows as they are, so long texts are read before it (``policies.read_texts``).
    """

    keyed = with_hash(rows)
    found = embedded.vectors.select("prompt_sha256", F.col("embedding").alias("_vector"))
    missing = F.raise_error(F.lit("a prompt has no embedding")).cast("array<float>")
    vector = F.when(F.col("_vector").isNull(), missing).otherwise(F.col("_vector"))
    return keyed.join(found, "prompt_sha256", "left").withColumn("embedding", vector).drop("prompt_sha256", "_vector")


def vector_violations(vectors: DataFrame, width: int) -> DataFrame:
    """(example_id, problem) for duplicates, wrong widths and non-finite entries."""

    e = F.col("embedding")
    bad_entry = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    problem = F.when(e.isNull() | (F.size(e) != width), "wrong width").when(bad_entry, "non-finite entry")
    shape = vectors.select("example_id", problem.alias("problem")).where("problem is not null")
    twice = checks.duplicate_keys(vectors, ["example_id"]).select("example_id", F.lit("duplicate").alias("problem"))
    return shape.unionByName(twice)


def match_violations(log: DataFrame, vectors: DataFrame) -> DataFrame:
    """Examples without a vector, vectors without an example, and changed prompts."""

    left = with_hash(log).select("example_id", F.col("prompt_sha256").alias("now"))
    right = vectors.select("example_id", F.col("prompt_sha256").alias("then"))
    problem = (
        F.when(F.col("then").isNull(), "no embedding")
        .when(F.col("now").isNull(), "no example")
        .when(F.col("now") != F.col("then"), "prompt changed")
    )
    return left.join(right, "example_id", "full").select("example_id", problem.alias("problem")).where("problem is not null")


def attach(log: DataFrame, vectors: DataFrame, width: int, validated: bool = False) -> DataFrame:
    """Adds ``embedding`` by example and prompt hash; any mismatch is an error.

    The join moves the rows as they are: a log of long texts comes from ``policies.read_texts``.
    """

    if not validated:
        checks.require_empty(vector_violations(vectors, width), "bad embedding")
        checks.require_empty(match_violations(log, vectors), "embeddings do not match the log")
    return with_hash(log).join(
        vectors.select("example_id", "prompt_sha256", "embedding"), ["example_id", "prompt_sha256"]
    ).drop("prompt_sha256")
