"""Running totals and nearest-step lookups that never put one key in one task.

A plain ``Window.partitionBy(key).orderBy(x)`` sends a whole key to one task.  Here all
rows are cut into ranges of the order first, so a (key, range) group holds at most one
range's share of all rows, however hot the key is.  Range totals (a map-side combined
aggregate, at most ``ranges`` rows per key) give each range its starting offset; they are
evaluated at once and sent to all tasks while they are few, so the rows are shuffled once.

Rows whose order values may repeat are cut by ``deal``: on the order, then the tie break,
then a hash of the row, so a common value spreads over ranges too.  ``with_range`` cuts on
the value alone and is for tables that hold each value once per key.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollway.functions.sizing import settle
from tollway.session import materialize, shuffle_width

RANGE = "_range"
_SORT_KEY = "_range_key"
_TIE = "_range_tie"
_DEAL = "_range_deal"
# Points of one key and range that share a sorted pass.
GROUP_POINTS = 200_000


def range_bounds(df: DataFrame, order: str, ranges: int | None = None) -> list[float]:
    """Cut points of the order column at approximate quantiles.

    One column-pruned scan.  Callers reuse the result when they pass over the same
    values again, so every pass agrees on the ranges.
    """

    ranges = ranges or shuffle_width(df.sparkSession)
    if ranges < 2:
        return []
    keyed = df.select(F.col(order).cast("double").alias(_SORT_KEY))
    probabilities = [i / ranges for i in range(1, ranges)]
    return sorted(set(keyed.approxQuantile(_SORT_KEY, probabilities, 1.0 / (4 * ranges))))


def with_range(df: DataFrame, order: str, bounds: list[float]) -> DataFrame:
    """Adds the range number; equal order values always share a range."""

    if not bounds:
        return df.withColumn(RANGE, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    keyed = df.withColumn(_SORT_KEY, F.col(order).cast("double"))
    cut = Bucketizer(splits=splits, inputCol=_SORT_KEY, outputCol=RANGE).transform(keyed)
    return cut.withColumn(RANGE, F.col(RANGE).cast("int")).drop(_SORT_KEY)


def deal(df: DataFrame, order: str, tie_break: list[str]) -> DataFrame:
    """A written copy with range numbers ascending in (order, tie break, hash of the row).

    Spark samples the sort key for the cut points.  The numbers are read from the written
    table, so every later pass agrees on them.  Only rows equal in every column must share
    a range.  Nulls come first.
    """

    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    tied = df.withColumn(_TIE, F.xxhash64(*hashed))
    cut = tied.repartitionByRange(shuffle_width(df.sparkSession), order, *tie_break, _TIE)
    return materialize(cut.withColumn(RANGE, F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column],
    bounds: list[float] | None = None,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """Inclusive running sums per key in the given order.

    ``sums`` maps new column names to the expressions to add up.  Rows that share an
    order value are put in a fixed sequence by ``tie_break``, then by a hash of the row.
    ``bounds`` are cut points for tables with distinct order values per key, from
    :func:`range_bounds`; without them the rows are dealt out by :func:`deal`.
    """

    added = df
    for name, expression in sums.items():
        added = added.withColumn(name, expression)
    if bounds is None:
        ranged = deal(added, order, tie_break or [])
        local = Window.partitionBy(*keys, RANGE).orderBy(order, *(tie_break or []), _TIE)
    else:
        ranged = with_range(added, order, bounds)
        local = Window.partitionBy(*keys, RANGE).orderBy(order, *(tie_break or []))
    local = local.rowsBetween(Window.unboundedPreceding, 0)
    if bounds is not None and not bounds:
        for name in sums:
            ranged = ranged.withColumn(name, F.sum(name).over(local))
        return ranged.drop(RANGE)
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(n).alias(f"_off_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(RANGE).alias("_k_range"),
        *[F.sum(f"_off_{n}").over(before).alias(f"_off_{n}") for n in sums],
    )
    offsets, _ = settle(offsets)
    out = ranged
    for name in sums:
        out = out.withColumn(name, F.sum(name).over(local))
    same = F.col(RANGE) == F.col("_k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = out.join(offsets, same, "left")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.coalesce(F.col(f"_off_{name}"), F.lit(0)))
    return out.select(*df.columns, *sums)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_k_{k}"])
    return same


def next_step(
    points: DataFrame,
    steps: DataFrame,
    keys: list[str],
    point: str,
    bound: str,
    value: str,
    group: int = GROUP_POINTS,
) -> DataFrame:
    """For each point the value of the first step whose bound is >= the point.

    Points above every bound take the last step; null points, and points of keys without
    steps, get null.  Neither side is joined or held: points and steps are cut into the same
    ranges, the points of a (key, range) are dealt to groups of about ``group`` rows however
    common a value is, and each group is one sorted pass over its points and a copy of the
    range's steps.  There are enough ranges to keep the copies below a tenth of a full group.
    A range that holds no later step takes the first step of a later range.
    """

    spark = points.sparkSession
    # The number that deals a point is written, so a task that runs again deals alike.
    written = materialize(points.withColumn(_DEAL, F.monotonically_increasing_id()), "points")
    ranges = max(shuffle_width(spark), -(-10 * steps.count() // group))
    bounds = range_bounds(steps, bound, ranges)
    live = with_range(written.where(F.col(point).isNotNull()), point, bounds)
    cut = [*keys, RANGE]

    counts = live.groupBy(*cut).agg(F.ceil(F.count(F.lit(1)) / F.lit(group)).cast("int").alias("_groups"))
    counts, _ = settle(materialize(counts, "point-counts"))
    named = counts.select(*[F.col(k).alias(f"_k_{k}") for k in cut], "_groups")
    dealt = live.join(named, _same(live, named, cut)).withColumn("_group", F.pmod(_DEAL, F.col("_groups")).cast("int"))

    marks = with_range(
        steps.select(*keys, F.col(bound).alias("_at"), F.struct(F.col(value).alias("v")).alias("_step")), "_at", bounds
    )
    firsts = marks.groupBy(*cut).agg(F.min_by("_step", "_at").alias("_first"))
    lasts = marks.groupBy(*keys).agg(F.max_by("_step", "_at").alias("_last"))
    # One row per (key, range) that occurs on either side; at most `ranges` per key.
    blank = F.lit(None).cast(firsts.schema["_first"].dataType)
    slots = firsts.unionByName(counts.select(*cut, blank.alias("_first"))).groupBy(*cut).agg(
        F.first("_first", ignorenulls=True).alias("_first")
    )
    later = Window.partitionBy(*keys).orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_later", F.last("_first", ignorenulls=True).over(later))
    ends = lasts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_last")
    beyond = slots.join(ends, _same(slots, ends, keys)).select(
        *cut, F.lit(None).cast(marks.schema["_at"].dataType).alias("_at"), F.coalesce("_later", "_last").alias("_step")
    )

    both = marks.select(*cut, "_at", "_step").unionByName(beyond)
    copies = both.join(named, _same(both, named, cut)).select(
        *cut, F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group"), "_at", "_step", F.lit(1).alias("_is_step")
    )
    row = F.struct(*[F.col(c) for c in points.columns])
    seen = dealt.select(
        *cut, "_group", F.col(point).alias("_at"), row.alias("_row"), F.lit(0).alias("_is_step")
    )
    # From the top down: what lies beyond the range, then each step before the points it covers.
    down = Window.partitionBy(*cut, "_group").orderBy(F.col("_at").desc_nulls_first(), F.col("_is_step").desc())
    down = down.rowsBetween(Window.unboundedPreceding, 0)
    merged = seen.unionByName(copies, allowMissingColumns=True).withColumn("_hit", F.last("_step", ignorenulls=True).over(down))
    found = merged.where("_is_step = 0").select("_row.*", F.col("_hit.v").alias(value))
    none = written.where(F.col(point).isNull()).withColumn(value, F.lit(None).cast(steps.schema[value].dataType))
    return found.unionByName(none.select(*points.columns, value))


def falls(steps: DataFrame, keys: list[str], bound: str, value: str) -> DataFrame:
    """Places at which a step table repeats a bound or its value falls; empty for a monotone one.

    Neighbours are compared inside ranges of the bound and across the ranges' ends, so no
    task holds a key.
    """

    ranged = with_range(steps.select(*keys, bound, value), bound, range_bounds(steps, bound))
    along = Window.partitionBy(*keys, RANGE).orderBy(bound)
    inner = ranged.select(*keys, bound, value, F.lag(F.struct(bound, value)).over(along).alias("_before"))
    here = F.struct(bound, value)
    ends = ranged.groupBy(*keys, RANGE).agg(F.min(here).alias("_low"), F.max(here).alias("_high"))
    across = F.lag("_high").over(Window.partitionBy(*keys).orderBy(RANGE))
    outer = ends.select(*keys, "_low.*", across.alias("_before"))
    wrong = (F.col(bound) <= F.col(f"_before.{bound}")) | (F.col(value) < F.col(f"_before.{value}"))
    return inner.unionByName(outer).where(wrong)
