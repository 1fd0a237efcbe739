"""Per-domain views for fitting: features without labels, and labels without features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.session import materialize


def feature_view(features: DataFrame) -> DataFrame:
    """Keys and features only; nothing a fit must not see of a held-out row."""

    return features.select("example_id", "domain", "x")


def label_view(log: DataFrame) -> DataFrame:
    """Keys and observed qualities only."""

    return log.select("example_id", "domain", F.transform("models", lambda m: m["quality"]).alias("targets"))


def by_domain(view: DataFrame, label: str) -> DataFrame:
    """The view written in one folder per domain, so a fold reads just its own files."""

    return materialize(view, label, ["domain"])
