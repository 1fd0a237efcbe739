"""Calibrated predictions of fitted scorers for rows or cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators.folds import SubsetPlan
from tollway.operators.isotonic import apply_steps
from tollway.operators.scoring import SHIP_BYTES, Calibrators, Scorer, StepTable, mask_passes, nano_array
from tollway.session import materialize


def _passes(scorer: Scorer, steps: Calibrators, masks: list[int]) -> list[list[int]]:
    groups: list[list[int]] = [[]]
    held = 0
    for m in masks:
        size = scorer.only([m]).size() + steps.only([m]).size()
        if groups[-1] and held + size > SHIP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(m)
        held += size
    return groups


def _features(x: pa.ListArray) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _nested(lists: np.ndarray, flat: np.ndarray, width: int) -> pa.ListArray:
    """Per row so many lists of ``width`` entries each, from one flat buffer."""

    inner = pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lists)).astype(np.int32)), pa.ListArray.from_arrays(inner, pa.array(flat)))


def _left_out_udf(plan: SubsetPlan, masks: list[int], kind: str, scored):
    """For each row the lists (mask, one value per model) of all subsets that left its domain out.

    ``scored`` gives a matrix of values for feature rows and a subset.
    """

    def run(x: pa.Array, domain: pa.Array) -> pa.Array:
        values = _features(x)
        names = domain.dictionary_encode()
        mine = [[m for m in masks if m & plan.bit(name)] for name in names.dictionary.to_pylist()]
        of_row = names.indices.to_numpy()
        lists = np.array([len(m) for m in mine], dtype=np.int64)[of_row] if mine else np.zeros(0, dtype=np.int64)
        rows = [np.flatnonzero(of_row == k) for k in range(len(mine))]
        blocks = [[scored(values[at], m) for m in own] for own, at in zip(mine, rows, strict=True)]
        width = 1 + next((block.shape[1] for part in blocks for block in part), 0)
        starts = (np.cumsum(lists) - lists) * width
        flat = np.empty(int(lists.sum()) * width, dtype=np.int64 if kind == "bigint" else np.float64)
        for own, at, part in zip(mine, rows, blocks, strict=True):
            for i, (m, block) in enumerate(zip(own, part, strict=True)):
                place = (starts[at] + i * width)[:, None] + np.arange(width)
                flat[place[:, 0]] = m
                flat[place[:, 1:]] = block
        return _nested(lists, flat, width)

    # the hints that say how a batch is passed are read at run time
    run.__annotations__ = {"x": pa.Array, "domain": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<array<{kind}>>")


def _excluding_udf(plan: SubsetPlan, scorer: Scorer, steps: Calibrators, masks: list[int]):
    return _left_out_udf(plan, masks, "bigint", lambda x, m: nano_array(steps.apply(scorer.score(x, m), m)))


def _calibrated(scored: DataFrame, steps: StepTable) -> DataFrame:
    """``scores`` of rows with ``mask`` replaced by ``predicted``, looked up in a step table of any length."""

    written = materialize(scored.withColumn("_rid", F.monotonically_increasing_id()), "scored")
    long = written.select("_rid", "mask", F.posexplode("scores").alias("model_pos", "score"))
    value = F.col("value")
    whole = F.when(
        value.isNull() | F.isnan(value) | (F.abs(value) >= 10), F.raise_error(F.lit("prediction must be finite and below 10 in size"))
    ).otherwise(F.rint(value * 1e9).cast("bigint"))
    found = apply_steps(long, steps.steps).select("_rid", F.struct("model_pos", whole.alias("q")).alias("_v"))
    lists = found.groupBy("_rid").agg(F.transform(F.array_sort(F.collect_list("_v")), lambda v: v["q"]).alias("predicted"))
    return written.join(lists, "_rid").drop("_rid", "scores")


def predict_excluding(rows: DataFrame, plan: SubsetPlan, scorer: Scorer, steps: Calibrators | StepTable, masks: list[int]) -> DataFrame:
    """One output row per input row and context that left the row's domain out.

    Adds ``mask`` and ``predicted`` (billionths, catalogue order).  Only the feature
    column and the domain visit Python; everything else stays on the JVM side.
    """

    out = None
    if isinstance(steps, StepTable):
        for group in mask_passes(scorer, masks):
            part = raw_scores(rows, plan, scorer.only(group), group)
            out = part if out is None else out.unionByName(part)
        return _calibrated(out, steps.only(masks))
    for group in _passes(scorer, steps, masks):
        udf = _excluding_udf(plan, scorer.only(group), steps.only(group), group)
        part = rows.withColumn("_p", F.explode(udf("x", "domain")))
        part = part.withColumn("mask", F.element_at("_p", 1).cast("int")).withColumn(
            "predicted", F.slice("_p", F.lit(2), F.size("_p") - 1)
        ).drop("_p")
        out = part if out is None else out.unionByName(part)
    return out


def predict_all(rows: DataFrame, scorer: Scorer, steps: Calibrators | StepTable, mask: int = 0) -> DataFrame:
    """Adds ``predicted`` from one fitted context, whatever the row's domain."""

    part_scorer, part_steps = scorer.only([mask]), steps.only([mask])
    if isinstance(part_steps, StepTable):
        scored = rows.withColumn("scores", _whole_udf(lambda x: part_scorer.score(x, mask), "double")("x"))
        return _calibrated(scored.withColumn("mask", F.lit(mask)), part_steps).drop("mask")
    udf = _whole_udf(lambda x: nano_array(part_steps.apply(part_scorer.score(x, mask), mask)), "bigint")
    return rows.withColumn("predicted", udf("x"))


def _whole_udf(scored, kind: str):
    """One list of values per row, from a function of the feature matrix."""

    def run(x: pa.Array) -> pa.Array:
        values = _features(x)
        out = scored(values) if len(values) else np.zeros((0, 0), dtype=np.int64 if kind == "bigint" else np.float64)
        return pa.ListArray.from_arrays(pa.array((np.arange(len(out) + 1) * out.shape[1]).astype(np.int32)), pa.array(out.ravel()))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<{kind}>")


def raw_scores(rows: DataFrame, plan: SubsetPlan, scorer: Scorer, masks: list[int]) -> DataFrame:
    """Uncalibrated scores: (.., mask, scores) for every subset that left the row's domain out."""

    udf = _left_out_udf(plan, masks, "double", scorer.score)
    part = rows.withColumn("_p", F.explode(udf("x", "domain")))
    return part.withColumn("mask", F.element_at("_p", 1).cast("int")).withColumn(
        "scores", F.slice("_p", F.lit(2), F.size("_p") - 1)
    ).drop("_p")


def long_predictions(rows: DataFrame) -> DataFrame:
    """(example_id, model_id, predicted_nano) from rows with models and predicted."""

    pairs = F.arrays_zip(F.transform("models", lambda m: m["model_id"]).alias("model_id"), F.col("predicted").alias("predicted"))
    return rows.select("example_id", F.inline(pairs)).toDF("example_id", "model_id", "predicted_nano")
