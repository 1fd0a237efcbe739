"""Monotone step calibration, fitted range by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollway.operators.folds import SubsetPlan
from tollway.operators.prefix import RANGE, next_step, range_bounds, with_range
from tollway.operators.scoring import Calibrators, Scorer, StepTable, mask_passes
from tollway.session import materialize

BLOCKS = "mask int, model_pos int, ub double, y double, n double"
# Blocks of one key that a pooling task takes in, and steps that a scoring task holds at most.
GROUP_BLOCKS = 50_000
MAX_LOCAL_STEPS = 4_000_000


def pool(ub: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacent violators pooled; input ascending in ``ub``, sums in ``y``, counts in ``n``."""

    tops: list[float] = []
    sums: list[float] = []
    counts: list[float] = []
    for top, total, count in zip(ub.tolist(), y.tolist(), n.tolist()):
        while sums and sums[-1] * count > total * counts[-1]:
            total += sums.pop()
            count += counts.pop()
            tops.pop()
        tops.append(top)
        sums.append(total)
        counts.append(count)
    return np.array(tops), np.array(sums), np.array(counts)


def calibration_pairs(cells: DataFrame, scorer: Scorer, plan: SubsetPlan, masks: list[int]) -> DataFrame:
    """Out-of-fold scores with observed sums: (mask, model_pos, score, y, n).

    A cell of domain f calibrates every context that trains on f, scored by the fit that
    also leaves f out.
    """

    parts = None
    for group in mask_passes(scorer, sorted({m | plan.bit(d) for m in masks for d in plan.domains if not m & plan.bit(d)})):
        held = set(group)
        part_scorer = scorer.only(group)

        def rows(batches: Iterator[pa.RecordBatch], held=held, part_scorer=part_scorer) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)  # noqa: E731, B023
                x_all, y_all, n_all = matrix("x"), matrix("y"), batch.column("n").to_numpy(zero_copy_only=False).astype(float)
                names = batch.column("domain").dictionary_encode()
                of_row = names.indices.to_numpy()
                for d, domain in enumerate(names.dictionary.to_pylist()):
                    at = np.flatnonzero(of_row == d)
                    x, y, n = x_all[at], y_all[at], n_all[at]
                    bit = plan.bit(domain)
                    for mask in masks:
                        if mask & bit or (mask | bit) not in held:
                            continue
                        raw = part_scorer.score(x, mask | bit)
                        size, heads = raw.shape
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(size * heads, mask, np.int32)), pa.array(np.tile(np.arange(heads, dtype=np.int32), size)),
                            pa.array(raw.ravel()), pa.array(y.ravel()), pa.array(np.repeat(n, heads)),
                        ], names=["mask", "model_pos", "ub", "y", "n"])

        slim = cells.select("domain", "n", "x", F.col("sum_q").cast("array<double>").alias("y"))
        part = slim.mapInArrow(rows, BLOCKS)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def fit(pairs: DataFrame, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Calibration blocks per (mask, model_pos).

    Equal scores are added up first.  Pooling adjacent violators in any order gives the same
    fit, so blocks are pooled in groups of at most ``group_blocks`` neighbours until no two
    neighbours are in the wrong order.  Every other pass shifts the groups by half their
    size, so each border lies inside a group of the next pass, and no pass gathers a key:
    a rising input keeps all its blocks, spread over all groups.  Passes end early because
    observed values are bounded: a block that has taken in k rising neighbours of total
    rise r stops before k * r / 2 exceeds that bound.
    """

    if group_blocks < 2:
        raise ValueError("a group holds two blocks at least")

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ub")
        ub, y, n = pool(pdf["ub"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame(
            {"mask": pdf["mask"].iloc[0], "model_pos": pdf["model_pos"].iloc[0], RANGE: pdf[RANGE].iloc[0],
             "ub": ub, "y": y, "n": n}
        )[["mask", "model_pos", RANGE, "ub", "y", "n"]]

    keys = ["mask", "model_pos"]
    merged = pairs.groupBy(*keys, "ub").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    merged = materialize(merged, "score-sums")
    largest = merged.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    ranges = -(-largest // group_blocks)
    schema = f"mask int, model_pos int, {RANGE} int, ub double, y double, n double"
    cut = with_range(merged, "ub", range_bounds(merged, "ub", ranges)).select(*keys, RANGE, "ub", "y", "n")
    shift = 0
    while True:
        blocks = materialize(cut.groupBy(*keys, RANGE).applyInPandas(pooled, schema), "blocks")
        # One row per group: its ends, its size, and the blocks of the groups before it.
        ends = blocks.groupBy(*keys, RANGE).agg(
            F.count(F.lit(1)).alias("size"),
            F.min_by(F.struct("y", "n"), "ub").alias("first"),
            F.max_by(F.struct("y", "n"), "ub").alias("last"),
        )
        along = Window.partitionBy(*keys).orderBy(RANGE)
        ends = ends.withColumns(
            {
                "before": F.lag("last").over(along),
                "offset": F.sum("size").over(along) - F.col("size"),
            }
        )
        wrong = F.col("before.y") * F.col("first.n") > F.col("first.y") * F.col("before.n")
        if ends.where(wrong).isEmpty():
            return blocks.select(*keys, "ub", (F.col("y") / F.col("n")).alias("value"), "n")
        shift = group_blocks // 2 - shift
        at = F.row_number().over(Window.partitionBy(*keys, RANGE).orderBy("ub")) - 1
        placed = blocks.withColumn("_at", at).join(ends.select(*keys, RANGE, "offset"), [*keys, RANGE])
        group = F.floor((F.col("offset") + F.col("_at") + shift) / group_blocks).cast("int")
        cut = placed.select(*keys, group.alias(RANGE), "ub", "y", "n")


def load(steps: DataFrame) -> Calibrators | StepTable:
    """A written step table as task state, or as the table it is when it is too long for that."""

    slim = steps.select("mask", "model_pos", "ub", "value")
    if slim.count() > MAX_LOCAL_STEPS:
        return StepTable(slim)
    out = {}
    for (mask, k), part in slim.toPandas().sort_values(["mask", "model_pos", "ub"]).groupby(["mask", "model_pos"]):
        out[(int(mask), int(k))] = (part["ub"].to_numpy(), part["value"].to_numpy())
    return Calibrators(out)


def apply_steps(scores: DataFrame, steps: DataFrame) -> DataFrame:
    """Calibrated values for (mask, model_pos, score) rows, whatever the step table's size."""

    return next_step(scores, steps.select("mask", "model_pos", "ub", "value"), ["mask", "model_pos"], "score", "ub", "value")
