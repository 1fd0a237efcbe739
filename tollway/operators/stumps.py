"""Boosted regression stumps for many training subsets and models at once.

A round is one job.  Tasks add up the residuals of their cells by feature value and send, with the sums of
a range of values, those of all values before it; so the task that gets a range searches its
splits at once.  Cells carry their scores by the stumps of earlier rounds, written anew every ``REFRESH`` rounds: a
round scores that many stumps at most, however long the chains are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators.folds import SubsetPlan
from tollway.operators.moments import Moments, combine
from tollway.operators.prefix import range_bounds
from tollway.operators.scoring import StumpScorer
from tollway.session import materialize

ROUNDS = 32
RATE = 0.1
MIN_LEAF = 2
# Gains that agree in this many digits are ties, settled by feature and then split value.
GAIN_DIGITS = 10
# Residuals are whole multiples of FINE, kept as a multiple of COARSE and a rest, so that sums of up to
# 2^31 are exact in any order and splits of the same rows have the same gain to the last bit.
COARSE, FINE = 2.0**-22, 2.0**-44
# Sums that a split search takes in at once, and those that a task adds up before it sends them.
RANGE_BYTES, CHUNK_BYTES = 64 * 1024 * 1024, 32 * 1024 * 1024
# Rounds after which scores are written beside the cells.
REFRESH = 8
# Kinds of sums: over all values of a feature, over those before a range, of one value.
TOTAL, BEFORE, VALUE = 0, 1, 2
SUMS = "feature int, range int, kind int, value double, v array<double>"
SPLITS = "mask int, model_pos int, gain double, feature int, value double, lv double, rv double"


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)]
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _scores(chunk: pa.RecordBatch, x: np.ndarray, scorer: StumpScorer, masks: list[int], held: list[int], done: int) -> Iterator[np.ndarray]:
    """Scores of a chunk's cells for each subset; those of ``held`` subsets go on from the column ``s``."""

    s = _matrix(chunk, "s") if held else None
    for mask in masks:
        n = len(scorer.base[mask])
        at = n * held.index(mask) if held else 0
        yield scorer.score(x, mask, s[:, at : at + n], done) if held else scorer.score(x, mask)


def residual_sums(cells: DataFrame, scorer: StumpScorer, plan: SubsetPlan, masks: list[int], bounds: list[float], held: list[int] | None = None, done: int = 0) -> DataFrame:
    """Sums over cells (domain, n, x, y, and s if scores are held) per feature and value, range by range.

    ``v`` holds the count of each subset, then the coarse parts of the residual sums of each
    subset's models, then their fine parts.  Tasks add up equal values before they send them.
    """

    cut, ranges, held = np.array(bounds), len(bounds) + 1, held or []
    width = sum(1 + 2 * len(scorer.base[m]) for m in masks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, max(1, CHUNK_BYTES // (8 * width))):
            x, y = _matrix(chunk, "x"), _matrix(chunk, "y")
            n = chunk.column("n").to_numpy(zero_copy_only=False).astype(float)
            bits = np.array([plan.bit(d) for d in chunk.column("domain").to_pylist()])
            member = np.stack([(bits & m) == 0 for m in masks], axis=1)
            scored = _scores(chunk, x, scorer, masks, held, done)
            r = np.concatenate([(y - n[:, None] * one) * member[:, i, None] for i, one in enumerate(scored)], axis=1)
            coarse = np.rint(r / COARSE) * COARSE
            v = np.concatenate([n[:, None] * member, coarse, np.rint((r - coarse) / FINE) * FINE], axis=1)
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                values, starts = np.unique(x[order, f], return_index=True)
                sums = np.add.reduceat(v[order], starts, axis=0)
                place = np.searchsorted(cut, values, side="right")
                per = np.zeros((ranges, v.shape[1]))
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                per[place[first]] = np.add.reduceat(sums, first, axis=0)
                along = np.cumsum(per, axis=0)
                every = np.arange(ranges)
                kind = np.repeat([TOTAL, BEFORE, VALUE], [ranges, ranges, len(values)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(kind), f, np.int32)), pa.array(np.r_[every, every, place].astype(np.int32)), pa.array(kind),
                    pa.array(np.r_[np.zeros(2 * ranges), values + 0.0]),  # + 0.0 leaves one zero for the shuffle
                    _lists(np.concatenate([np.tile(along[-1], (ranges, 1)), along - per, sums])),
                ], names=["feature", "range", "kind", "value", "v"])

    return cells.mapInArrow(rows, SUMS)


def best_splits(sums: DataFrame, masks: list[int], n_models: int, min_leaf: int) -> DataFrame:
    """Best split per (mask, model): largest gain, then lowest feature, then lowest value.

    Each range of a feature's values is searched by itself, from the sums of the ranges
    before it; only one candidate per range and head goes on.
    """

    m = len(masks)

    def search(feature: int, value: np.ndarray, v: np.ndarray, before: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        left = np.cumsum(v, axis=0) - v + before
        # A value that a subset does not hold splits nothing of its own.
        nl, nr = left[:, :m], total[:m] - left[:, :m]
        fits = (v[:, :m] > 0) & (nl >= min_leaf) & (nr >= min_leaf)
        # Both sides are exact sums until their two parts are put together.
        sides = lambda a: a[..., m:].reshape(*a.shape[:-1], 2, m, n_models).sum(axis=-3)
        l, r, t = sides(left), sides(total - left), sides(total)
        nl, nr, tn = np.where(fits, nl, 1.0)[:, :, None], np.where(fits, nr, 1.0)[:, :, None], np.maximum(total[:m], 1.0)[:, None]
        gain = np.where(fits[:, :, None], l * l / nl + r * r / nr - t * t / tn, -np.inf)
        at = np.round(gain, GAIN_DIGITS).argmax(axis=0)
        take = lambda a: np.take_along_axis(a, at[None], axis=0)[0].ravel()
        keep = np.isfinite(take(gain))
        columns = [
            np.repeat(masks, n_models).astype(np.int32), np.tile(np.arange(n_models), m).astype(np.int32), take(gain),
            np.full(m * n_models, feature, np.int32), value[at.ravel()], take(l / nl), take(r / nr),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=[c.split()[0] for c in SPLITS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, plain, values, parts = None, {}, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            f, r, kind, value = (batch.column(c).to_numpy() for c in ("feature", "range", "kind", "value"))
            v = _matrix(batch, "v")
            # rows of one value stand together and are added up as they come
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in (f, r, kind, value)], axis=0)])
            added = np.add.reduceat(v, new, axis=0)
            for i, at in enumerate(new.tolist()):
                if (f[at], r[at]) != key:
                    if values:
                        yield search(key[0], np.array(values), np.stack(parts), plain[BEFORE], plain[TOTAL])
                    key, plain, values, parts = (f[at], r[at]), {}, [], []
                if kind[at] != VALUE:
                    plain[kind[at]] = plain.get(kind[at], 0.0) + added[i]
                elif values and values[-1] == value[at]:
                    parts[-1] = parts[-1] + added[i]
                else:
                    values.append(value[at])
                    parts.append(added[i])
        if values:
            yield search(key[0], np.array(values), np.stack(parts), plain[BEFORE], plain[TOTAL])

    split = sums.repartition("feature", "range").sortWithinPartitions("feature", "range", "kind", "value").mapInArrow(run, SPLITS)
    order = F.struct((-F.round("gain", GAIN_DIGITS)).alias("g"), "feature", "value")
    best = F.min_by(F.struct("gain", "feature", "value", "lv", "rv"), order)
    return split.groupBy("mask", "model_pos").agg(best.alias("b")).select("mask", "model_pos", "b.*")


def _with_scores(cells: DataFrame, scorer: StumpScorer, masks: list[int], held: list[int], done: int) -> DataFrame:
    """The cells with the scores of all subsets by the chains so far, written."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, max(1, CHUNK_BYTES // (8 * sum(len(scorer.base[m]) for m in masks)))):
            s = np.concatenate(list(_scores(chunk, _matrix(chunk, "x"), scorer, masks, held, done)), axis=1)
            yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in ("domain", "n", "x", "y")), _lists(s)], names=["domain", "n", "x", "y", "s"])

    return materialize(cells.mapInArrow(rows, "domain string, n long, x array<double>, y array<double>, s array<double>"), "scored-cells")


def fit(
    cells: DataFrame,
    by_domain: dict[str, Moments],
    plan: SubsetPlan,
    masks: list[int],
    rounds: int = ROUNDS,
    rate: float = RATE,
    min_leaf: int = MIN_LEAF,
    min_gain: float = 0.0,
) -> StumpScorer:
    """Stump chains for every subset and model; one Spark job per boosting round.

    Residuals follow from target sums and scores, which are written every ``REFRESH`` rounds, so
    rounds add no lineage.  The driver holds only the chains.
    """

    if not 0 < rate <= 1 or min_leaf < 1 or rounds < 1 or min_gain < 0:
        raise ValueError("bad boosting parameters")
    n_models = len(next(iter(by_domain.values())).sy)
    base = {}
    for m in masks:
        total = combine(by_domain, plan.excluded(m))
        base[m] = total.sy / total.n
    chains: dict[int, list[list[tuple[int, float, float, float]]]] = {m: [[] for _ in range(n_models)] for m in masks}
    active = {(m, k) for m in masks for k in range(n_models)}
    slim = materialize(cells.select("domain", F.col("n").cast("long").alias("n"), "x", F.col("sum_q").cast("array<double>").alias("y")), "stump-cells")
    points = slim.select(F.posexplode("x").alias("feature", "value")).distinct()
    size = points.count() * 8 * sum(1 + 2 * n_models for _ in masks)
    bounds = range_bounds(points, "value", -(-size // RANGE_BYTES))
    held: list[int] = []
    done = 0
    for number in range(rounds):
        live = sorted({m for m, _ in active})
        if not live:
            break
        scorer = StumpScorer(rate, base, chains)
        if number - done == REFRESH:
            slim, held, done = _with_scores(slim, scorer, masks, held, done), masks, number
        sums = residual_sums(slim, scorer.only(live), plan, live, bounds, held, done)
        found = {(r["mask"], r["model_pos"]): r for r in best_splits(sums, live, n_models, min_leaf).collect()}
        for head in sorted(active):
            r = found.get(head)
            if r is None or r["gain"] <= max(min_gain, 10.0**-GAIN_DIGITS):
                active.discard(head)
                continue
            chains[head[0]][head[1]].append((r["feature"], r["value"], r["lv"], r["rv"]))
    return StumpScorer(rate, base, chains)
