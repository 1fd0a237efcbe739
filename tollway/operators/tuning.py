"""Exact search for the price of cost when the rows of a ledger share one budget.

What a row chooses then depends on lambda and on what earlier rows left, so no curve adds
up row by row.  Two facts keep the search exact without a replay of every lambda:

* A model is chosen only below its smallest root with a cheaper one, whatever is
  affordable: what fits a balance is all quotes up to it, and cheaper models always fit
  with a dearer one.  Between two neighbouring such roots of a ledger's rows every replay
  is the same, and the smallest lambda of that stretch is the root itself.
* For an interval of lambda each row has a few models that a replay without infeasible
  rows can choose.  Their charges bound the balance of later rows from both sides, which
  in turn narrows what those can choose; their qualities bound the sum.

Intervals whose bound does not reach the best replay so far are given up, the others are
replayed at their smallest lambda and split.  Nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollway.operators.lambdas import KEY, root_key
from tollway.operators.ledger import per_query_columns, settle
from tollway.operators.policies import cost_units, lambda_rule
from tollway.operators.prefix import range_bounds, running_totals
from tollway.schema import COST_SUM, TierSpec, with_tiers
from tollway.session import materialize

QUALITY_SUM = "decimal(38,12)"
# Pieces an interval is cut into, and intervals of one ledger that a round looks at.
FAN = 8
LIVE = 8
# The most promising of them, which are replayed.
TRIES = 2
# Passes that narrow the balances of an interval.
NARROWINGS = 2


def _options(fits: Column) -> Column:
    """Models that some lambda and balance choose, with the roots that end and start their reign.

    ``hi`` is the smallest root with a cheaper model (null for none): from there on the
    model is not chosen.  ``above`` lists the dearer models that beat it up to a root.
    """

    def root(better: Column, worse: Column) -> Column:
        dq, dc = better["q"] - worse["q"], (better["c"] - worse["c"]).cast("decimal(13,0)")
        return F.struct(
            root_key(dq, dc).alias("key"), (dq * 1000).cast("bigint").alias("num"), dc.cast("bigint").alias("den")
        )

    def never(m: Column) -> Column:
        return F.exists(
            fits,
            lambda j: ((j["c"] < m["c"]) & (j["q"] >= m["q"]))
            | ((j["c"] == m["c"]) & ((j["q"] > m["q"]) | ((j["q"] == m["q"]) & (j["model_id"] < m["model_id"])))),
        )

    def option(m: Column) -> Column:
        cheaper = F.filter(fits, lambda j: j["c"] < m["c"])
        dearer = F.filter(fits, lambda j: (j["c"] > m["c"]) & (j["q"] > m["q"]))
        return F.struct(
            m["quoted"].alias("quoted"), m["realized"].alias("realized"), m["quality"].alias("quality"),
            F.array_min(F.transform(cheaper, lambda j: root(m, j))).alias("hi"),
            F.transform(dearer, lambda j: F.struct(j["quoted"].alias("quoted"), root(j, m)["key"].alias("key"))).alias("above"),
        )

    return F.transform(F.filter(fits, lambda m: ~never(m)), option)


def _ledger_rows(log: DataFrame, tiers: list[TierSpec], ledger_keys: list[str]) -> DataFrame:
    rows = with_tiers(log.select(*dict.fromkeys(["example_id", "ord", "models", "predicted", *ledger_keys])), tiers)
    scored = F.zip_with(
        F.col("models"), F.col("predicted"),
        lambda m, q: F.struct(
            m["model_id"].alias("model_id"), m["quoted"].alias("quoted"), m["realized"].alias("realized"),
            m["quality"].alias("quality"), cost_units(m["quoted"]).alias("c"), q.alias("q"),
        ),
    )
    rows = rows.withColumn("_s", F.filter(scored, lambda m: m["quoted"] <= F.col("budget")))
    return rows.withColumn("_o", _options(F.col("_s"))).drop("_s")


def switch_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Zero and every lambda at which a row of the ledger can change its choice, numbered from 1."""

    ends = rows.select(*keys, F.explode(F.transform("_o", lambda m: m["hi"])).alias("r")).where("r is not null")
    zero = F.struct(
        F.lit(0).cast(KEY).alias("key"), F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den")
    )
    every = ends.unionByName(rows.select(*keys).distinct().withColumn("r", zero))
    points = every.groupBy(*keys, F.col("r.key").alias("key")).agg(F.min(F.struct("r.den", "r.num")).alias("f"))
    points = materialize(points.select(*keys, "key", F.col("f.num").alias("num"), F.col("f.den").alias("den")), "switch-points")
    numbered = running_totals(points, keys, "key", {"idx": F.lit(1).cast("bigint")}, range_bounds(points, "key"))
    return materialize(numbered, "switch-points")


def _pieces(whole: DataFrame, first: Column, last: Column, fan: int) -> DataFrame:
    """Candidates ``first`` to ``last`` in at most ``fan`` runs of nearly equal length (a, b)."""

    size = last - first + 1
    n = F.least(size, F.lit(fan).cast("bigint"))
    cut = whole.where(size > 0).withColumns({"_n": n, "_first": first, "_size": size})
    cut = cut.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    start = lambda k: F.col("_first") + F.floor(k * F.col("_size") / F.col("_n")).cast("bigint")
    return cut.withColumns({"a": start(F.col("_k")), "b": start(F.col("_k") + 1) - 1}).drop("_n", "_first", "_size", "_k")


def _keyed(intervals: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the fraction and key at ``a`` and the key at ``b``."""

    low = grid.select(*keys, F.col("idx").alias("a"), F.col("key").alias("ka"), "num", "den")
    high = grid.select(*keys, F.col("idx").alias("b"), F.col("key").alias("kb"))
    return intervals.join(low, [*keys, "a"]).join(high, [*keys, "b"])


def interval_bounds(rows: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Most quality (``most``) and least spend (``least``) of any feasible replay within each interval.

    ``intervals`` has the ledger keys, ``a`` and the keys of lambda ``ka`` to ``kb``.  Intervals
    in which no replay can be feasible are left out.
    """

    own = [*keys, "a"]

    def choice(m: Column) -> Column:
        """A model that some lambda of the interval chooses, and the balance from which a dearer one always beats it."""

        beats = F.filter(m["above"], lambda j: (j["key"] > F.col("kb")) | F.coalesce(j["key"] >= m["hi"]["key"], F.lit(False)))
        return F.struct(
            m["quoted"].alias("quoted"), m["realized"].alias("realized"), m["quality"].alias("quality"),
            F.array_min(F.transform(beats, lambda j: j["quoted"])).alias("beaten"),
        )

    def possible() -> Column:
        return F.filter(
            "_c",
            lambda m: (m["quoted"] <= F.col("_high")) & (m["realized"] <= F.col("_high"))
            & (m["beaten"].isNull() | (m["beaten"] > F.col("_low"))),
        )

    def charge(pick, models: Column) -> Column:
        return F.coalesce(pick(F.transform(models, lambda m: m["realized"])), F.lit(0)).cast(COST_SUM)

    bounds = range_bounds(rows, "ord")
    slim = rows.select(*keys, "ord", "budget", "_o").join(intervals.select(*own, "ka", "kb"), keys)
    reached = F.filter("_o", lambda m: m["hi"].isNull() | (m["hi"]["key"] > F.col("ka")))
    slim = slim.select(*own, "ord", "budget", F.transform(reached, choice).alias("_c"))
    slim = slim.withColumns({"_low": F.lit(0).cast(COST_SUM), "_high": F.col("budget").cast(COST_SUM)})
    for _ in range(NARROWINGS):
        left = slim.withColumn("_p", possible())
        left = left.withColumns({"_min": charge(F.array_min, F.col("_p")), "_max": charge(F.array_max, F.col("_p"))})
        left = materialize(left.drop("_p", "_low", "_high"), "balances")
        summed = running_totals(left, own, "ord", {"_smin": F.col("_min"), "_smax": F.col("_max")}, bounds)
        slim = summed.withColumns(
            {
                "_low": F.greatest(F.col("budget") - (F.col("_smax") - F.col("_max")), F.lit(0)).cast(COST_SUM),
                "_high": (F.col("budget") - (F.col("_smin") - F.col("_min"))).cast(COST_SUM),
            }
        ).drop("_min", "_max", "_smin", "_smax")
    last = slim.withColumn("_p", possible())
    found = last.groupBy(*own).agg(
        F.sum(F.array_max(F.transform("_p", lambda m: m["quality"]))).cast(QUALITY_SUM).alias("most"),
        F.sum(charge(F.array_min, F.col("_p"))).cast(COST_SUM).alias("least"),
        F.min(F.size("_p")).alias("_fewest"), F.first("budget").alias("_budget"),
    )
    return found.where((F.col("_fewest") > 0) & (F.col("least") <= F.col("_budget"))).drop("_fewest", "_budget")


def _replayed(rows: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Exact replay of each (ledger, lambda): sums, and whether every row was feasible."""

    own = [*keys, "a"]
    pending = rows.drop("_o", "weight").join(points.select(*own, "num", "den"), keys).withColumn("policy", F.lit("candidate"))
    if "observable_tag" not in keys:
        pending = pending.withColumn("observable_tag", F.lit(None).cast("string"))
    pending = materialize(pending, "candidate-rows")
    state = pending.groupBy(*own).agg(F.first("budget").cast(COST_SUM).alias("balance"), (F.min("ord") - 1).alias("pos"))
    out = settle(pending, state, own, [lambda_rule(F.col("num"), F.col("den"), "candidate")])
    out = out.withColumns(per_query_columns(F.col("models"), F.col("_d"), F.col("_r")))
    return out.groupBy(*own).agg(
        F.sum("quality").cast(QUALITY_SUM).alias("quality_sum"), F.sum("cost").cast(COST_SUM).alias("spend"),
        F.bool_and("feasible").alias("feasible"),
    )


def _hopeful(intervals: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (most, least, ka) that may still hold a better lambda than the best so far."""

    same = F.col("most") == F.col("best_quality")
    beats = F.col("most").isNull() | F.col("best_quality").isNull() | (F.col("most") > F.col("best_quality")) | (
        same & (F.col("least") < F.col("best_spend"))
    ) | (same & (F.col("least") == F.col("best_spend")) & (F.col("ka") < F.col("best_key")))
    known = best.select(
        *keys, F.col("quality_sum").alias("best_quality"), F.col("spend").alias("best_spend"), F.col("key").alias("best_key")
    )
    return intervals.join(known, keys, "left").where(beats).select(*intervals.columns)


def tune_shared_budget(
    log: DataFrame,
    tiers: list[TierSpec],
    ledger_keys: list[str] | None = None,
    fan: int = FAN,
    live: int = LIVE,
    tries: int = TRIES,
) -> DataFrame:
    """Best lambda of all lambdas per tier and ledger when a ledger's ordered rows share its budget.

    ``log`` carries ``predicted``; ``ord`` is unique within a ledger and the ledger keys are
    not null.  The best replay has no infeasible row, most quality, then least spend, then the
    smallest lambda; a ledger without such a replay has no row.  ``replayed`` tells how many of
    the ledger's ``candidates`` were replayed in full.  A round takes at most ``live`` intervals
    of a ledger, the most promising first, and replays the first ``tries`` of them; the others
    wait for a later round, none is dropped but by its bound.
    """

    if fan < 2 or live < 1 or tries < 1:
        raise ValueError("an interval is cut into two pieces at least, and a round takes and replays one at least")
    keys = ["tier", *(ledger_keys or [])]
    rows = materialize(_ledger_rows(log, tiers, ledger_keys or []), "tuning-rows")
    grid = switch_points(rows, keys)
    sizes = grid.groupBy(*keys).agg(F.max("idx").alias("candidates"))
    unknown = {"most": F.lit(None).cast(QUALITY_SUM), "least": F.lit(None).cast(COST_SUM)}
    start = _pieces(sizes, F.lit(1).cast("bigint"), F.col("candidates"), fan).withColumns(unknown)
    fields = [*keys, "a", "b", "most", "least", "ka", "kb", "num", "den"]
    waiting = materialize(_keyed(start.drop("candidates"), grid, keys).select(*fields), "intervals")
    spark = log.sparkSession
    best = tried = None
    result = [*keys, "key", "num", "den", "quality_sum", "spend"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("most").desc_nulls_first(), "least", "ka"))
    while not waiting.isEmpty():
        ranked = waiting.withColumn("_place", place)
        taken = materialize(ranked.where(F.col("_place") <= live).drop("_place"), "taken")
        later = ranked.where(F.col("_place") > live).drop("_place")
        bounded = taken.drop("most", "least").join(interval_bounds(rows, taken, keys), [*keys, "a"]).select(*fields)
        if best is not None:
            bounded = _hopeful(bounded, best, keys)
        bounded = materialize(bounded.withColumn("_try", place <= tries), "bounded")
        tries_now = bounded.where("_try")
        points = tries_now.select(*keys, "a", F.col("ka").alias("key"), "num", "den")
        replays = materialize(_replayed(rows, tries_now, keys).join(points, [*keys, "a"]), "replays")
        count = replays.groupBy(*keys).agg(F.count(F.lit(1)).alias("replayed"))
        tried = count if tried is None else tried.unionByName(count)
        good = replays.where("feasible").select(*result)
        good = good if best is None else best.unionByName(good)
        top = F.min(F.struct((-F.col("quality_sum")).alias("m"), "spend", "key", "num", "den", "quality_sum"))
        best = good.groupBy(*keys).agg(top.alias("t")).select(
            *keys, "t.key", "t.num", "t.den", "t.quality_sum", "t.spend"
        )
        best = materialize(best, "best")
        first = F.col("_a") + F.col("_try").cast("bigint")
        whole = bounded.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b"), "most", "least", "_try")
        rest = _pieces(whole, first, F.col("_b"), fan)
        rest = _keyed(rest.drop("_a", "_b", "_try"), grid, keys).select(*fields)
        waiting = materialize(_hopeful(rest.unionByName(later.select(*fields)), best, keys), "intervals")
    if best is None:
        best = spark.createDataFrame([], grid.drop("idx").schema).withColumns(
            {"quality_sum": F.lit(None).cast(QUALITY_SUM), "spend": F.lit(None).cast(COST_SUM)}
        )
        tried = sizes.select(*keys, F.lit(0).cast("bigint").alias("replayed"))
    effort = tried.groupBy(*keys).agg(F.sum("replayed").alias("replayed"))
    return best.select(*keys, "num", "den", "quality_sum", "spend").join(sizes, keys).join(effort, keys)
