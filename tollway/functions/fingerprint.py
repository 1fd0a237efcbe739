"""Order-free table identities that merge across partitions.

Each row is hashed; the hashes are combined by count, sum and exclusive-or, so a partial
result per partition is enough and no row order is needed.  Where order matters the
position is one of the hashed columns.  Fields carry their lengths, so no value can pass
for another or for null.  The purpose is to notice mixed-up inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NULL = "-"


def row_digest(columns: list[Column]) -> Column:
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit(_NULL)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _slice(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row (per key): number of rows, sum of digests and two exclusive-ors."""

    hashed = df.select(*(keys or []), row_digest([F.col(c) for c in columns]).alias("_d"))
    first, second = _slice(F.col("_d"), 1), _slice(F.col("_d"), 16)
    grouped = hashed.groupBy(*keys) if keys else hashed.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(first.cast("decimal(38,0)")).cast("string").alias("digest_sum"),
        F.bit_xor(first).alias("digest_xor_a"),
        F.bit_xor(second).alias("digest_xor_b"),
    )


def identity(df: DataFrame, columns: list[str]) -> str:
    """The fingerprint of a whole table as one hex string."""

    row = fingerprint(df, columns).first()
    text = "|".join(str(v) for v in row)
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def long_models(log: DataFrame) -> DataFrame:
    """One row per example and model; the text is hashed once, before the models fan out."""

    facts = ["example_id", "ord", "domain", "observable_tag"]
    text = F.sha2("prompt", 256).alias("prompt_sha256")
    return log.select(*facts, text, F.explode("models").alias("m")).select(*facts, "prompt_sha256", "m.*")


def data_identity(log: DataFrame) -> DataFrame:
    """Identity of the logged rows whatever their order."""

    return fingerprint(
        long_models(log),
        ["example_id", "prompt_sha256", "domain", "observable_tag", "model_id", "quoted", "realized", "quality"],
    )


def replay_identity(log: DataFrame) -> DataFrame:
    """Identity of the logged rows in their replay order."""

    return fingerprint(
        long_models(log),
        ["ord", "example_id", "prompt_sha256", "domain", "observable_tag", "model_id", "quoted", "realized", "quality"],
    )


def fold_identity(log: DataFrame, domains: list[str]) -> DataFrame:
    """Identity of each fold's ordered training and test members."""

    from tollway.operators.folds import with_folds

    return fingerprint(with_folds(log, domains), ["role", "ord", "example_id"], ["held_out"])


def prediction_identity(predictions: DataFrame) -> DataFrame:
    return fingerprint(predictions, ["example_id", "model_id", "predicted_nano"])


def decision_identity(results: DataFrame) -> DataFrame:
    return fingerprint(results, ["tier", "example_id", "decision"], ["policy"])
