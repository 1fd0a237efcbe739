"""Mergeable first and second moments per domain, taken about each domain's own mean.

Raw second sums of a feature with a large mean lose its spread to rounding.  Every domain's
sums are therefore taken about its mean, which a first pass over the cells finds; they stay
plain sums, so the JVM adds them up, and a merge moves both sides to the joint mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.schema import MAX_DOMAINS

# Partial sums per domain are merged in this many slots before the last step, so no task
# takes in more than a slot's share of the partitions.
MERGE_SLOTS = 64
# Width of the widest feature row: its moments (about 70 MB per domain) still fit a task.
MAX_WIDTH = 4096


@dataclass(frozen=True)
class Moments:
    """Sums over rows: count, x - at, y, (x - at) (x - at)' and (x - at) y'."""

    n: float
    sx: np.ndarray
    sy: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray
    at: np.ndarray | float = field(default=0.0)

    @property
    def mean_x(self) -> np.ndarray:
        return self.at + self.sx / self.n

    def moved(self, to: np.ndarray) -> Moments:
        """The same rows' sums about another centre."""

        d = self.at - to
        cross = np.outer(self.sx, d)
        return Moments(
            self.n, self.sx + self.n * d, self.sy, self.sxx + cross + cross.T + self.n * np.outer(d, d),
            self.sxy + np.outer(d, self.sy), to,
        )

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        joint = (self.n * self.mean_x + other.n * other.mean_x) / n
        a, b = self.moved(joint), other.moved(joint)
        return Moments(n, a.sx + b.sx, a.sy + b.sy, a.sxx + b.sxx, a.sxy + b.sxy, joint)

    @property
    def centered(self) -> tuple[np.ndarray, np.ndarray]:
        """Co-moments about the means: x with x, and x with y."""

        return (
            self.sxx - np.outer(self.sx, self.sx) / self.n,
            self.sxy - np.outer(self.sx, self.sy) / self.n,
        )


def _pack(m: Moments) -> np.ndarray:
    upper = np.triu_indices(len(m.sx))
    return np.concatenate([[m.n], m.sx, m.sy, m.sxx[upper], m.sxy.ravel()])


def unpack(flat: np.ndarray, width: int, n_models: int, at: np.ndarray | float = 0.0) -> Moments:
    flat = np.asarray(flat, dtype=float)
    sx, rest = flat[1 : 1 + width], flat[1 + width :]
    sy, rest = rest[:n_models], rest[n_models:]
    size = width * (width + 1) // 2
    sxx = np.zeros((width, width))
    sxx[np.triu_indices(width)] = rest[:size]
    sxx = sxx + np.triu(sxx, 1).T
    return Moments(float(flat[0]), sx, sy, sxx, rest[size:].reshape(width, n_models), at)


def domain_moments(cells: DataFrame, width: int, n_models: int) -> DataFrame:
    """One row (domain, centre, moments) per domain from two passes over the cells.

    The first finds each domain's mean.  In the second each task adds up its own cells about
    the mean with matrix products and emits one array per domain; the arrays are summed on
    the JVM in two steps.
    """

    if width > MAX_WIDTH:
        raise ValueError(f"feature rows are wider than {MAX_WIDTH}")
    mean = Summarizer.mean(array_to_vector("x"), F.col("n").cast("double"))
    means = cells.groupBy("domain").agg(vector_to_array(mean).alias("m")).limit(MAX_DOMAINS + 1).collect()
    if len(means) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    centre = {r["domain"]: np.array(r["m"]) for r in means}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            x = np.stack(pdf["x"].to_list())
            y = np.stack(pdf["y"].to_list())
            n = pdf["n"].to_numpy(dtype=float)
            for domain, at in pdf.groupby("domain").indices.items():
                xd, yd, nd = x[at] - centre[domain], y[at], n[at]
                weighted = xd * nd[:, None]
                part = _pack(Moments(nd.sum(), weighted.sum(0), yd.sum(0), xd.T @ weighted, xd.T @ yd))
                held[domain] = held[domain] + part if domain in held else part
        if held:
            yield pd.DataFrame({"domain": list(held), "centre": [centre[d] for d in held], "v": list(held.values())})

    slim = cells.select("domain", "n", "x", F.col("sum_q").cast("array<double>").alias("y"))
    parts = slim.mapInPandas(partial, "domain string, centre array<double>, v array<double>")
    slotted = parts.select(
        "domain", "centre", (F.spark_partition_id() % MERGE_SLOTS).alias("slot"), array_to_vector("v").alias("v")
    )
    # A domain's centre is the same in all its rows.
    merged = slotted.groupBy("domain", "slot").agg(F.first("centre").alias("centre"), Summarizer.sum(F.col("v")).alias("v"))
    return merged.groupBy("domain").agg(
        F.first("centre").alias("centre"), vector_to_array(Summarizer.sum(F.col("v"))).alias("moments")
    )


def load(moments: DataFrame, width: int, n_models: int) -> dict[str, Moments]:
    """The per-domain moments on the driver: at most 16 rows of fixed size."""

    rows = moments.limit(MAX_DOMAINS + 1).collect()
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    return {r["domain"]: unpack(np.array(r["moments"]), width, n_models, np.array(r["centre"])) for r in rows}


def combine(by_domain: dict[str, Moments], leave_out: list[str]) -> Moments:
    kept = [m for d, m in sorted(by_domain.items()) if d not in leave_out]
    total = kept[0]
    for m in kept[1:]:
        total = total + m
    return total
