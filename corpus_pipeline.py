"""A training-data pipeline: five stages over the table ``documents``, each one operator of ``tollway.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tollway.llm import bpe, decontaminate, pii, quality, simhash
from tollway.llm.common import materialize, table
from tollway.llm.queries import DEMO_KEY, vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; languages are measured on the stage's own input."""

    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""

    return simhash.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item."""

    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal values."""

    return pii.pseudonymize_text(docs, DEMO_KEY)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""

    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("pseudonyms", pseudonyms),
    ("tokens", tokens),
]

#: Tokenization and alignment have no SQL form; tests compare the rows with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written and read again."""

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
