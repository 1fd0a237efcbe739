"""Centered ridge regression on merged moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tollway.functions.encode import CONTINUOUS, FIRST_TAG, SURFACE_WIDTH
from tollway.operators.folds import SubsetPlan
from tollway.operators.moments import Moments, combine
from tollway.operators.scoring import LinearScorer

COEFFICIENTS = "mask int, model_pos int, weights array<double>, bias double"


def solve(m: Moments, ridge: float, scaled: int = len(CONTINUOUS), surface: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Weights on raw features (models x width) and biases.

    The first ``scaled`` columns are standardised by the subset's own population scale
    before the penalty applies; tag columns the subset never saw stay out of the fit.  All
    models share one factorisation.
    """

    if ridge < 0:
        raise ValueError("ridge must be non-negative")
    xx, xy = m.centered
    width = len(m.sx)
    scale = np.ones(width)
    deviation = np.sqrt(np.maximum(np.diag(xx)[:scaled], 0.0) / m.n)
    scale[:scaled] = np.where(deviation > 0, deviation, 1.0)
    kept = np.ones(width, dtype=bool)
    if surface:
        kept[FIRST_TAG:SURFACE_WIDTH] = m.mean_x[FIRST_TAG:SURFACE_WIDTH] > 0
    a = (xx / np.outer(scale, scale))[np.ix_(kept, kept)] + ridge * np.eye(int(kept.sum()))
    b = (xy / scale[:, None])[kept]
    fitted = np.zeros((width, xy.shape[1]))
    fitted[kept] = np.linalg.solve(a, b)
    weights = (fitted / scale[:, None]).T
    bias = m.sy / m.n - weights @ m.mean_x
    if not (np.isfinite(weights).all() and np.isfinite(bias).all()):
        raise ValueError("ridge fit is not finite")
    return weights, bias


def fit_subsets(
    spark: SparkSession, by_domain: dict[str, Moments], plan: SubsetPlan, masks: list[int], ridge: float
) -> DataFrame:
    """Coefficient rows for every subset, one solve per task row."""

    excluded = {mask: plan.excluded(mask) for mask in masks}

    def solve_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for mask in pdf["mask"]:
                w, b = solve(combine(by_domain, excluded[mask]), ridge)
                out += [(mask, k, w[k], float(b[k])) for k in range(len(b))]
            yield pd.DataFrame(out, columns=["mask", "model_pos", "weights", "bias"])

    table = spark.createDataFrame([(m,) for m in masks], "mask int")
    return table.repartition(min(len(masks), spark.sparkContext.defaultParallelism)).mapInPandas(
        solve_rows, COEFFICIENTS
    )


def load(coefficients: DataFrame) -> LinearScorer:
    """Coefficients as task state: subsets x models x width numbers."""

    weights: dict[int, dict[int, np.ndarray]] = {}
    bias: dict[int, dict[int, float]] = {}
    for r in coefficients.collect():
        weights.setdefault(r["mask"], {})[r["model_pos"]] = np.array(r["weights"])
        bias.setdefault(r["mask"], {})[r["model_pos"]] = r["bias"]
    return LinearScorer(
        {m: np.stack([w[k] for k in sorted(w)]) for m, w in weights.items()},
        {m: np.array([b[k] for k in sorted(b)]) for m, b in bias.items()},
    )
