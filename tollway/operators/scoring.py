"""Fitted scorers: plain numeric state that tasks apply to feature rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

# Largest model state shipped to tasks at once; larger sets go in several passes.
SHIP_BYTES = 64 * 1024 * 1024


@dataclass(frozen=True)
class LinearScorer:
    """Per training subset: a weight row and a bias for each model."""

    weights: dict[int, np.ndarray]  # mask -> (models, width)
    bias: dict[int, np.ndarray]  # mask -> (models,)

    def score(self, x: np.ndarray, mask: int) -> np.ndarray:
        # Column by column, so a row's score never depends on its batch.
        w = self.weights[mask]
        out = np.tile(self.bias[mask], (len(x), 1))
        for j in range(w.shape[1]):
            out = out + x[:, j, None] * w[None, :, j]
        return out

    def only(self, masks: list[int]) -> LinearScorer:
        return LinearScorer({m: self.weights[m] for m in masks}, {m: self.bias[m] for m in masks})

    def size(self) -> int:
        return sum(w.nbytes for w in self.weights.values())


@dataclass(frozen=True)
class StumpScorer:
    """Per training subset and model: base value and (feature, split, left, right) stumps."""

    rate: float
    base: dict[int, np.ndarray]
    stumps: dict[int, list[list[tuple[int, float, float, float]]]]

    def score(self, x: np.ndarray, mask: int, scored: np.ndarray | None = None, done: int = 0) -> np.ndarray:
        """Scores by the whole chains, or by the stumps after the first ``done`` on top of what those ``scored``."""

        out = np.tile(self.base[mask], (len(x), 1)) if scored is None else scored.copy()
        for k, chain in enumerate(self.stumps[mask]):
            for f, split, left, right in chain[done:]:
                out[:, k] = out[:, k] + self.rate * np.where(x[:, f] < split, left, right)
        return out

    def only(self, masks: list[int]) -> StumpScorer:
        return StumpScorer(self.rate, {m: self.base[m] for m in masks}, {m: self.stumps[m] for m in masks})

    def size(self) -> int:
        return sum(32 * len(c) for s in self.stumps.values() for c in s) + sum(b.nbytes for b in self.base.values())


Scorer = LinearScorer | StumpScorer


@dataclass(frozen=True)
class Calibrators:
    """Step functions per (context mask, model position), closed on the right."""

    steps: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def apply(self, raw: np.ndarray, mask: int) -> np.ndarray:
        out = np.empty_like(raw)
        for k in range(raw.shape[1]):
            bounds, values = self.steps[(mask, k)]
            place = np.minimum(np.searchsorted(bounds, raw[:, k], side="left"), len(values) - 1)
            out[:, k] = values[place]
        return out

    def only(self, masks: list[int]) -> Calibrators:
        wanted = set(masks)
        return Calibrators({k: v for k, v in self.steps.items() if k[0] in wanted})

    def size(self) -> int:
        return sum(b.nbytes + v.nbytes for b, v in self.steps.values())


@dataclass(frozen=True)
class StepTable:
    """Step functions too many for a task's memory: a written table (mask, model_pos, ub, value)."""

    steps: DataFrame

    def only(self, masks: list[int]) -> StepTable:
        return StepTable(self.steps.where(self.steps["mask"].isin(masks)))


def nano_array(predictions: np.ndarray) -> np.ndarray:
    """Predictions in whole billionths; the exact unit of all later comparisons."""

    if not np.all(np.abs(predictions) < 10):
        raise ValueError("prediction must be finite and below 10 in size")
    return np.rint(predictions * 1e9).astype(np.int64)


def mask_passes(scorer: Scorer, masks: list[int], limit: int = SHIP_BYTES) -> list[list[int]]:
    """Masks in groups whose model state stays under the shipping limit."""

    groups: list[list[int]] = [[]]
    held = 0
    for m in masks:
        size = scorer.only([m]).size()
        if groups[-1] and held + size > limit:
            groups.append([])
            held = 0
        groups[-1].append(m)
        held += size
    return groups
