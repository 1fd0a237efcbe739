"""Own embedding providers and quality predictors as vectorised Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators.scoring import nano_array


def with_embedding(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], width: int, prompt: str = "prompt") -> DataFrame:
    """Adds ``embedding`` from a provider that is loaded once per Python worker.

    ``load`` returns a function from a list of texts to an array (texts x width).
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in batches:
            out = np.asarray(embed(texts.to_list()), dtype=np.float32)
            if out.shape != (len(texts), width) or not np.isfinite(out).all():
                raise ValueError("embedding provider gave a wrong shape or a non-finite entry")
            yield pd.Series(list(out))

    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(prompt)))


def with_predictions(log: DataFrame, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], model_ids: list[str]) -> DataFrame:
    """Adds ``predicted`` from an own predictor, loaded once per Python worker.

    ``load`` returns a function from texts and model IDs to scores (texts x models).
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for texts in batches:
            scores = np.asarray(predict(texts.to_list(), model_ids), dtype=float)
            if scores.shape != (len(texts), len(model_ids)):
                raise ValueError("predictor must score every model of every prompt")
            yield pd.Series(nano_array(scores).tolist())

    return log.withColumn("predicted", F.pandas_udf(run, "array<bigint>")(F.col("prompt")))
