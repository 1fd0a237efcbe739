"""Search for the price of cost: candidate lambdas, the full metric curve, selection.

Scores are whole billionths and quotes whole 1e-12 units, so a root is a ratio of whole
numbers.  Its key is that ratio with 28 decimals: distinct roots of admissible inputs
differ by more than 1e-26, so equal keys mean equal roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollway.operators.policies import cost_units
from tollway.operators.prefix import range_bounds, running_totals
from tollway.schema import COST_SUM, TierSpec, with_tiers
from tollway.session import materialize

KEY = "decimal(38,28)"
# Denominator that values other than roots are rounded to.
GRID_DEN = 10**12


def root_key(dq: Column, dc: Column) -> Column:
    return (dq.cast("decimal(36,26)") / dc.cast("decimal(13,0)")).cast(KEY)


def fraction_key(num: Column, den: Column) -> Column:
    """Key of lambda = num/den in quality per cost."""

    return (num.cast("decimal(36,21)") / (den.cast("decimal(13,0)") * 1000).cast("decimal(16,0)")).cast(KEY)


def lambda_value(num: Column, den: Column) -> Column:
    return num.cast("double") / den.cast("double")


def scored_models() -> Column:
    """Candidates of a log row with its ``predicted`` array, costs in whole units."""

    return F.zip_with(
        F.col("models"),
        F.col("predicted"),
        lambda m, q: F.struct(
            m["model_id"].alias("model_id"), m["quoted"].alias("quoted"), cost_units(m["quoted"]).alias("c"), q.alias("q")
        ),
    )


def breakpoints(rows: DataFrame, scored: Column, keep: list[str]) -> DataFrame:
    """One row per non-negative pairwise root: key, dq, dc.

    Pairs are formed inside the row from its own catalogue.
    """

    def against(m: Column) -> Column:
        later = F.filter(scored, lambda j: (j["c"] < m["c"]) & (j["q"] <= m["q"]))
        return F.transform(
            later, lambda j: F.struct((m["q"] - j["q"]).alias("dq"), (m["c"] - j["c"]).cast("decimal(13,0)").alias("dc"))
        )

    pairs = F.flatten(F.transform(scored, against))
    out = rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")
    return out.withColumn("key", root_key(F.col("dq"), F.col("dc")))


def _with_fraction(df: DataFrame) -> DataFrame:
    """Roots as public fractions: dq thousandths-scaled over dc."""

    return df.withColumn("num", (F.col("dq") * 1000).cast("bigint")).withColumn("den", F.col("dc").cast("bigint"))


def distinct_roots(points: DataFrame, by: list[str]) -> DataFrame:
    """{0} and the distinct roots, each with how often it was observed."""

    roots = _with_fraction(points).groupBy(*by, "key").agg(
        F.min(F.struct("den", "num")).alias("f"), F.count(F.lit(1)).alias("observed")
    ).select(*by, "key", F.col("f.num").alias("num"), F.col("f.den").alias("den"), "observed")
    zero_keys = points.select(*by).distinct() if by else points.sparkSession.range(1).select()
    zero = zero_keys.select(
        *by, F.lit(0).cast(KEY).alias("key"), F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"),
        F.lit(0).cast("bigint").alias("observed"),
    )
    return roots.unionByName(zero).groupBy(*by, "key").agg(
        F.min(F.struct("den", "num")).alias("f"), F.sum("observed").alias("observed")
    ).select(*by, "key", F.col("f.num").alias("num"), F.col("f.den").alias("den"), "observed")


def _snapped(key: Column) -> tuple[Column, Column]:
    """Nearest fraction with the grid denominator."""

    return F.round(key * 1000 * GRID_DEN, 0).cast("bigint"), F.lit(GRID_DEN).cast("bigint")


def neighbours(boundaries: DataFrame, by: list[str], bounds: list[float] | None = None) -> DataFrame:
    """Adds the next larger key of the same group without gathering a group in one task."""

    from tollway.operators.prefix import RANGE, with_range

    bounds = range_bounds(boundaries, "key") if bounds is None else bounds
    ranged = with_range(boundaries, "key", bounds)
    local = Window.partitionBy(*by, RANGE).orderBy("key")
    firsts = ranged.groupBy(*by, RANGE).agg(F.min("key").alias("_first"))
    seq = Window.partitionBy(*by).orderBy(RANGE)
    following = firsts.withColumn("_next_first", F.lead("_first").over(seq)).drop("_first")
    out = ranged.withColumn("next_key", F.lead("key").over(local))
    same = [*by, RANGE]
    out = out.join(following, same, "left")
    return out.withColumn("next_key", F.coalesce("next_key", "_next_first")).drop("_next_first", RANGE)


def exhaustive_candidates(boundaries: DataFrame, by: list[str]) -> DataFrame:
    """Boundaries, midpoints of neighbours, and the last boundary plus one."""

    boundaries = materialize(boundaries, "boundaries")
    near = neighbours(boundaries, by)
    # One unit of lambda is 0.001 in key units.
    mid = F.when(
        F.col("next_key").isNotNull(), ((F.col("key") + F.col("next_key")) / 2).cast(KEY)
    ).otherwise((F.col("key") + F.lit("0.001").cast(KEY)).cast(KEY))
    num, den = _snapped(mid)
    between = near.select(
        *by, mid.alias("key"), num.alias("num"), den.alias("den"),
        F.when(F.col("next_key").isNotNull(), "midpoint").otherwise("tail").alias("kind"),
    )
    at = boundaries.select(*by, "key", "num", "den", F.lit("boundary").alias("kind"))
    return at.unionByName(between)


def bounded_roots(points: DataFrame, by: list[str], cap: int, salts: int = 64) -> DataFrame:
    """The ``cap`` roots with the smallest hash per group, plus zero, minimum and maximum.

    The cap is this operator's own sampling parameter.  Roots are cut to the cap inside
    hash slices first, so no group is ranked in one task.
    """

    roots = distinct_roots(points, by).withColumn("_h", F.sha2(F.col("key").cast("string"), 256))
    roots = roots.withColumn("_salt", F.pmod(F.hash("_h"), F.lit(salts)))
    real = roots.where("observed > 0")
    short = real.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy("_h"))
    ).where(F.col("_rn") <= cap)
    kept = short.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_rn") <= cap)
    ends = real.groupBy(*by).agg(
        F.min(F.struct("key", "num", "den")).alias("a"), F.max(F.struct("key", "num", "den")).alias("b")
    ).select(*by, F.explode(F.array("a", "b")).alias("e")).select(*by, "e.*")
    zero = roots.where("key = 0").select(*by, "key", "num", "den")
    return kept.select(*by, "key", "num", "den").unionByName(ends).unionByName(zero).dropDuplicates([*by, "key"])


def rank_spaced(candidates: DataFrame, by: list[str], size: int) -> DataFrame:
    """At most ``size`` values at evenly spaced ranks, first and last included.

    Works on an already bounded candidate set (at most 2 * cap + 6 values per group).
    """

    if size < 2:
        raise ValueError("a candidate cap must be at least two")
    values = candidates.dropDuplicates([*by, "key"])
    ordered = values.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("key")) - 1)
    sized = ordered.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    last = F.col("_n") - 1
    # Index i is kept when it is floor(j * last / (size - 1)) for some j.
    j = F.ceil(F.try_divide(F.col("_i") * F.lit(size - 1), last))
    hit = F.floor(j * last / F.lit(size - 1)) == F.col("_i")
    return sized.where((F.col("_n") <= size) | hit).drop("_i", "_n")


def candidate_summary(points: DataFrame, by: list[str], cap: int | None = None) -> DataFrame:
    """Strategy, exhaustiveness and counts of a derived candidate set."""

    roots = distinct_roots(points, by)
    counts = roots.groupBy(*by).agg(
        F.sum("observed").alias("observed"), F.count(F.lit(1)).alias("n_boundaries"),
        F.count_if(F.col("observed") > 0).alias("n_roots"),
    )
    derived = F.col("n_boundaries") * 2
    if cap is None:
        exhaustive = F.lit(True)
    else:
        exhaustive = (derived <= cap) & (F.col("n_roots") <= cap)
    return counts.withColumns(
        {
            "exhaustive": exhaustive,
            "strategy": F.when(exhaustive, "exhaustive").otherwise("bounded-hash-sample"),
            "n_derived": F.when(exhaustive, derived),
        }
    )


def winner_intervals(scored: Column) -> Column:
    """For each candidate the lambdas at which it is chosen: [lo, hi).

    A candidate beats dearer ones from their common root on (ties go to the cheaper) and
    cheaper ones strictly before it; of equal quotes only the better score, then the
    smaller ID, is ever chosen.  Struct fields: i, lo(key, num, den), hi(key, num, den).
    """

    def root(dq: Column, dc: Column) -> Column:
        d = dc.cast("decimal(13,0)")
        return F.struct(
            root_key(dq, d).alias("key"), (dq * 1000).cast("bigint").alias("num"), d.cast("bigint").alias("den")
        )

    zero = F.struct(
        F.lit(0).cast(KEY).alias("key"), F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den")
    )

    def interval(m: Column, i: Column) -> Column:
        dearer = F.filter(scored, lambda j: (j["c"] > m["c"]) & (j["q"] > m["q"]))
        cheaper = F.filter(scored, lambda j: j["c"] < m["c"])
        lo = F.array_max(F.transform(dearer, lambda j: root(j["q"] - m["q"], j["c"] - m["c"])))
        hi = F.array_min(F.transform(cheaper, lambda j: root(m["q"] - j["q"], m["c"] - j["c"])))
        twin = F.exists(
            scored,
            lambda j: (j["c"] == m["c"]) & ((j["q"] > m["q"]) | ((j["q"] == m["q"]) & (j["model_id"] < m["model_id"]))),
        )
        return F.struct(m["pos"].alias("pos"), F.coalesce(lo, zero).alias("lo"), hi.alias("hi"), twin.alias("twin"))

    found = F.transform(scored, interval)
    return F.filter(found, lambda w: ~w["twin"] & (w["hi"].isNull() | (w["lo"]["key"] < w["hi"]["key"])))


def change_events(rows: DataFrame, by: list[str]) -> DataFrame:
    """Changes of quality, spend and infeasible count along lambda, per (by, tier).

    ``rows`` has quotes, predicted, n, sum_q, sum_c, over (this tier's counts), model_ids
    and budget.  A row emits at most two events per candidate.
    """

    scored = F.filter(
        F.transform(
            F.arrays_zip("quotes", "predicted", "model_ids"),
            lambda m, i: F.struct(
                i.alias("pos"), m["model_ids"].alias("model_id"), m["quotes"].alias("quoted"),
                cost_units(m["quotes"]).alias("c"), m["predicted"].alias("q"),
            ),
        ),
        lambda m: m["quoted"] <= F.col("budget"),
    )
    rows = rows.withColumn("_s", scored)
    wins = rows.withColumn("_w", winner_intervals(F.col("_s")))

    def change(point: Column, pos: Column, sign: int) -> Column:
        return F.struct(
            point["key"].alias("key"), point["num"].alias("num"), point["den"].alias("den"),
            (F.get(F.col("sum_q"), pos) * sign).cast("decimal(38,12)").alias("dq"),
            (F.get(F.col("sum_c"), pos) * sign).cast("decimal(38,12)").alias("dc"),
            (F.get(F.col("over"), pos) * sign).cast("bigint").alias("di"),
        )

    starts = F.transform("_w", lambda w: change(w["lo"], w["pos"], 1))
    stops = F.transform(F.filter("_w", lambda w: w["hi"].isNotNull()), lambda w: change(w["hi"], w["pos"], -1))
    none = F.array(
        F.struct(
            F.lit(0).cast(KEY).alias("key"), F.lit(0).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"),
            F.lit(0).cast("decimal(38,12)").alias("dq"), F.lit(0).cast("decimal(38,12)").alias("dc"),
            F.col("n").cast("bigint").alias("di"),
        )
    )
    events = F.when(F.size("_s") == 0, none).otherwise(F.concat(starts, stops))
    flat = wins.select(*by, "tier", F.explode(events).alias("e")).select(*by, "tier", "e.*")
    return flat.groupBy(*by, "tier", "key").agg(
        F.min(F.struct("den", "num")).alias("f"), F.sum("dq").alias("dq"), F.sum("dc").alias("dc"), F.sum("di").alias("di")
    ).select(*by, "tier", "key", F.col("f.num").alias("num"), F.col("f.den").alias("den"), "dq", "dc", "di")


def log_rows(log: DataFrame, tiers: list[TierSpec]) -> DataFrame:
    """A scored log as sweep input, one row per example and tier (n = 1)."""

    rows = with_tiers(log, tiers)
    over = F.transform("models", lambda m: (m["realized"] > F.col("budget")).cast("bigint"))
    return rows.withColumns(
        {
            "quotes": F.transform("models", lambda m: m["quoted"]),
            "model_ids": F.transform("models", lambda m: m["model_id"]),
            "n": F.lit(1).cast("bigint"),
            "sum_q": F.transform("models", lambda m: m["quality"].cast("decimal(38,12)")),
            "sum_c": F.transform("models", lambda m: m["realized"].cast("decimal(38,12)")),
            "over": over,
        }
    )


def curve(events: DataFrame, by: list[str]) -> DataFrame:
    """Quality sum, spend and infeasible count at every event lambda.

    The events, already added up per lambda, are written once; running totals over ranges
    of lambda follow, and no task holds a whole curve.
    """

    events = materialize(events, "lambda-events")
    out = running_totals(
        events, [*by, "tier"], "key",
        {"quality_sum": F.col("dq"), "spend": F.col("dc"), "n_infeasible": F.col("di")},
        range_bounds(events, "key"),
    )
    return out.select(
        *by, "tier", "key", "num", "den", F.col("quality_sum").cast("decimal(38,12)").alias("quality_sum"),
        F.col("spend").cast(COST_SUM).alias("spend"), "n_infeasible",
    )


def at_grid(curve_rows: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """The curve at given (by, tier, key, num, den) values: the last event at or below each.

    Grids are short (a cap's worth of values per group).  Each curve row goes to the first
    grid value that covers it, the largest per value survives a map-side combined
    aggregate, and empty grid values take over from the one before.
    """

    keys = [*by, "tier"]
    short = grid.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("key", "num", "den"))).alias("g"))
    near = curve_rows.join(short, keys).withColumn("v", F.get(F.filter("g", lambda v: v["key"] >= F.col("key")), F.lit(0)))
    point = F.struct("key", "quality_sum", "spend", "n_infeasible")
    tops = near.where("v is not null").groupBy(*keys, F.col("v.key").alias("_at")).agg(F.max(point).alias("c"))
    slots = short.select(*keys, F.explode("g").alias("v"))
    same = F.col("v.key") == F.col("_at")
    for k in keys:
        same = same & (slots[k] == tops[k])
    joined = slots.join(tops, same, "left").select(*[slots[k] for k in keys], "v", "c")
    before = Window.partitionBy(*keys).orderBy("v.key").rowsBetween(Window.unboundedPreceding, 0)
    filled = joined.withColumn("c", F.last("c", ignorenulls=True).over(before))
    return filled.select(
        *keys, F.col("v.key").alias("key"), F.col("v.num").alias("num"), F.col("v.den").alias("den"),
        "c.quality_sum", "c.spend", "c.n_infeasible",
    )


def select_best(curve_rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group and tier: most quality, then least spend, then smallest lambda; feasible only."""

    ok = curve_rows.where("n_infeasible = 0")
    best = F.min(
        F.struct((-F.col("quality_sum")).alias("a"), F.col("spend").alias("spend"), F.col("key").alias("key"),
                 F.col("num").alias("num"), F.col("den").alias("den"))
    )
    return ok.groupBy(*by, "tier").agg(best.alias("b")).select(
        *by, "tier", F.col("b.num").alias("num"), F.col("b.den").alias("den"),
        (-F.col("b.a")).alias("quality_sum"), F.col("b.spend").alias("spend"),
    )


def search_size(log: DataFrame, tiers: list[TierSpec], cap: int | None = None) -> DataFrame:
    """Work a search would take: pair scans, unequal-cost pairs, candidate and evaluation bounds."""

    m = F.size("models").cast("bigint")
    quotes = F.transform("models", lambda c: c["quoted"])
    same = F.aggregate(
        F.array_distinct(quotes), F.lit(0).cast("bigint"),
        lambda acc, v: acc + (lambda k: k * (k - 1) / 2)(F.size(F.filter(quotes, lambda q: q == v)).cast("bigint")).cast("bigint"),
    )
    sized = log.select(m.alias("m"), (m * (m - 1) / 2).cast("bigint").alias("pairs"), same.alias("same"))
    sums = sized.agg(
        F.count(F.lit(1)).alias("n_examples"), F.sum("m").alias("n_candidates"), F.sum("pairs").alias("pair_scans"),
        F.sum(F.col("pairs") - F.col("same")).alias("unequal_pairs"),
    )
    bound = (F.col("unequal_pairs") + 1) * 2
    per_tier = F.least(bound, F.lit(cap)) if cap is not None else bound
    total = (per_tier * len(tiers)).cast("bigint")
    return sums.withColumns(
        {"candidate_bound": total, "utility_bound": (total.cast("decimal(20,0)") * F.col("n_candidates")).cast("decimal(38,0)")}
    )


def tune_cumulative(
    log: DataFrame,
    tiers: list[TierSpec],
    grid: list[tuple[int, int]],
    ledger_keys: list[str] | None = None,
) -> DataFrame:
    """Best grid lambda per tier when each tier's budget is shared by the whole ordered log.

    ``log`` carries ``predicted``.  Every grid value is one policy of a single sequential
    replay, so all (tier, lambda) ledgers advance together.
    """

    from tollway.operators.ledger import sequential_replay
    from tollway.operators.policies import shared_lambda

    rules = [shared_lambda(num, den, f"{num}/{den}") for num, den in grid]
    results = sequential_replay(log, tiers, rules, ledger_keys)
    scores = results.groupBy("policy", "tier", *(ledger_keys or [])).agg(
        F.sum("quality").cast("decimal(38,12)").alias("quality_sum"),
        F.sum("cost").cast(COST_SUM).alias("spend"),
        F.count_if(~F.col("feasible")).alias("n_infeasible"),
    )
    num, den = F.split("policy", "/")[0].cast("bigint"), F.split("policy", "/")[1].cast("bigint")
    rows = scores.withColumns({"num": num, "den": den}).withColumn("key", fraction_key(F.col("num"), F.col("den")))
    return select_best(rows, ledger_keys or [])
