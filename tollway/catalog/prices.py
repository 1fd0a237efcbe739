"""Lambda policies and the lambda search on scores SQL can reproduce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.catalog.baselines import SHOWN_SQL, SQL_CALLS, shown_results
from tollway.catalog.registry import query
from tollway.catalog.sample import DENSE_BUDGETS, TIGHT_BUDGETS, predicted_log, sql_log, tiers
from tollway.functions.costs import micro
from tollway.operators import lambdas, policies, tuning
from tollway.operators.folds import domain_list, with_folds
from tollway.operators.ledger import replay

# Scores in billionths and quotes in 1e-12 units, as whole numbers.
_SCORED = "sc AS (SELECT *, CAST(q * 500000 + blur * 1000000 AS HUGEINT) AS nano, CAST(quoted AS HUGEINT) * 1000000 AS pico FROM lt)"


def scored_sql(budgets: dict[str, int] = DENSE_BUDGETS) -> str:
    return f"{sql_log(budgets)}, {_SCORED}"


def lambda_pick_sql(name: str, num: str, den: str) -> str:
    """Affordable model with the largest den * 1000 * nano - num * pico, then quote, then ID."""

    return f"""SELECT '{name}' AS policy, tier, example_id, model_id FROM sc WHERE quoted <= budget
  QUALIFY row_number() OVER (PARTITION BY tier, example_id ORDER BY ({den}) * 1000 * nano - ({num}) * pico DESC, quoted, model_id) = 1"""


@query("policy_shared_lambda", "B7 B8", f"WITH {scored_sql()}, picks AS ({lambda_pick_sql('shared-lambda', '1', '5')}), {SQL_CALLS}" + SHOWN_SQL)
def policy_shared_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_results(replay(predicted_log(spark, sf_dir), tiers(), [policies.shared_lambda(1, 5)]))


_NUM = "CASE tier WHEN 'fast' THEN 4 WHEN 'balanced' THEN 7 ELSE 2 END"
_DEN = "CASE tier WHEN 'fast' THEN 5 WHEN 'balanced' THEN 20 ELSE 25 END"


@query("policy_tier_lambda", "B9 J7", f"WITH {scored_sql(TIGHT_BUDGETS)}, picks AS ({lambda_pick_sql('tier-lambda', _NUM, _DEN)}), {SQL_CALLS}" + SHOWN_SQL)
def policy_tier_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_results(replay(predicted_log(spark, sf_dir), tiers(TIGHT_BUDGETS), [policies.tier_lambda(policies.DEMO_LAMBDAS)]))


_POINTS = """pts AS (SELECT a.example_id, a.domain, a.nano - b.nano AS dq, a.pico - b.pico AS dc,
  (2 * (a.nano - b.nano) * 10000000000000000000000000000::HUGEINT + (a.pico - b.pico)) // (2 * (a.pico - b.pico)) AS key
  FROM sc a JOIN sc b USING (example_id, tier) WHERE tier = 'fast' AND a.pico > b.pico AND a.nano >= b.nano)"""


def points(log: DataFrame, keep: list[str]) -> DataFrame:
    return lambdas.breakpoints(log, lambdas.scored_models(), keep)


@query("lambda_breakpoints", "L1 J6", f"WITH {scored_sql()}, {_POINTS} SELECT example_id, CAST(dq AS BIGINT) AS dq, CAST(dc AS BIGINT) AS dc, CAST(key AS VARCHAR) AS key FROM pts")
def lambda_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(predicted_log(spark, sf_dir), ["example_id"])
    digits = F.regexp_replace(F.replace(F.col("key").cast("string"), F.lit("."), F.lit("")), "^0+(?=.)", "")
    return p.select("example_id", "dq", F.col("dc").cast("bigint").alias("dc"), digits.alias("key"))


_CANDIDATES = """bnd AS (SELECT key, min(num) AS num, arg_min(den, num) AS den FROM (
    SELECT key, CAST(dq * 1000 AS BIGINT) AS num, CAST(dc AS BIGINT) AS den FROM pts UNION ALL SELECT 0, 0, 1) GROUP BY key),
nx AS (SELECT *, lead(key) OVER (ORDER BY key) AS nk FROM bnd),
cand AS (SELECT 'boundary' AS kind, key, num::DOUBLE / den AS lam FROM bnd
  UNION ALL SELECT CASE WHEN nk IS NULL THEN 'tail' ELSE 'midpoint' END, CASE WHEN nk IS NULL THEN key + 10000000000000000000000000 ELSE (key + nk) // 2 END,
    CASE WHEN nk IS NULL THEN CAST((key + 10000000000000000000000000 + 5000000000000) // 10000000000000 AS DOUBLE) / 1e12
         ELSE CAST((key + nk + 10000000000000) // 20000000000000 AS DOUBLE) / 1e12 END FROM nx)"""


@query("lambda_candidates", "L2 W4 U3", f"WITH {scored_sql()}, {_POINTS}, {_CANDIDATES} SELECT kind, round(lam, 9) AS lam FROM cand")
def lambda_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every boundary, every midpoint and the tail."""

    roots = lambdas.distinct_roots(points(predicted_log(spark, sf_dir), []), [])
    c = lambdas.exhaustive_candidates(roots, [])
    return c.select("kind", F.round(lambdas.lambda_value(F.col("num"), F.col("den")), 9).alias("lam"))


_SAMPLE = """real AS (SELECT key, min(CAST(dq * 1000 AS BIGINT)) AS num, arg_min(CAST(dc AS BIGINT), dq) AS den FROM pts GROUP BY key),
low AS (SELECT * FROM real ORDER BY sha256(CAST(key // 10000000000000000000000000000 AS VARCHAR) || '.' || lpad(CAST(key % 10000000000000000000000000000 AS VARCHAR), 28, '0')) LIMIT {cap}),
bnd AS (SELECT key, any_value(num) AS num, any_value(den) AS den FROM (
  SELECT * FROM low UNION ALL (SELECT * FROM real ORDER BY key LIMIT 1) UNION ALL (SELECT * FROM real ORDER BY key DESC LIMIT 1) UNION ALL SELECT 0, 0, 1) GROUP BY key),
nx AS (SELECT *, lead(key) OVER (ORDER BY key) AS nk FROM bnd),
cand AS (SELECT key, num::DOUBLE / den AS lam FROM bnd
  UNION ALL SELECT CASE WHEN nk IS NULL THEN key + 10000000000000000000000000 ELSE (key + nk) // 2 END,
    CASE WHEN nk IS NULL THEN CAST((key + 10000000000000000000000000 + 5000000000000) // 10000000000000 AS DOUBLE) / 1e12
         ELSE CAST((key + nk + 10000000000000) // 20000000000000 AS DOUBLE) / 1e12 END FROM nx),
ranked AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM cand)"""


@query("bounded_lambda_candidates", "L3 L4 W10 U3", f"WITH {scored_sql()}, {_POINTS}, {_SAMPLE.format(cap=32)} SELECT round(lam, 9) AS lam FROM ranked WHERE i IN (SELECT (j * (n - 1)) // 31 FROM range(32) t(j))")
def bounded_lambda_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 rank-spaced values out of a 32-root hash sample."""

    sample = lambdas.bounded_roots(points(predicted_log(spark, sf_dir), []), [], 32)
    spaced = lambdas.rank_spaced(lambdas.exhaustive_candidates(sample, []), [], 32)
    return spaced.select(F.round(lambdas.lambda_value(F.col("num"), F.col("den")), 9).alias("lam"))


@query("lambda_candidate_summary", "L5", f"""WITH {scored_sql()}, {_POINTS}, s AS (SELECT domain, count(*) AS observed, count(DISTINCT key) FILTER (key > 0) + 1 AS n_boundaries FROM pts GROUP BY domain)
SELECT domain, observed, n_boundaries, FALSE AS exhaustive, 'bounded-hash-sample' AS strategy FROM s""")
def lambda_candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambdas.candidate_summary(points(predicted_log(spark, sf_dir), ["domain"]), ["domain"], cap=64)
    return s.select("domain", "observed", "n_boundaries", "exhaustive", "strategy")


@query("lambda_search_size", "L9", f"""WITH {sql_log()}, e AS (SELECT example_id, count(*) AS m, count(*) * (count(*) - 1) // 2 AS pairs FROM long GROUP BY example_id),
same AS (SELECT example_id, sum(k * (k - 1) // 2) AS same FROM (SELECT example_id, quoted, count(*) AS k FROM long GROUP BY ALL) GROUP BY example_id)
SELECT count(*) AS n_examples, CAST(sum(m) AS BIGINT) AS n_candidates, CAST(sum(pairs) AS BIGINT) AS pair_scans, CAST(sum(pairs - same) AS BIGINT) AS unequal_pairs,
  CAST(3 * 2 * (sum(pairs - same) + 1) AS BIGINT) AS candidate_bound, CAST(3 * 2 * (sum(pairs - same) + 1) * sum(m) AS BIGINT) AS utility_bound FROM e JOIN same USING (example_id)""")
def lambda_search_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambdas.search_size(predicted_log(spark, sf_dir), tiers())
    return s.withColumn("utility_bound", F.col("utility_bound").cast("bigint"))


# Brute force: each row's choice at zero and at each of its own roots, then differences.
_SWEEP = """aff AS (SELECT * FROM sc WHERE quoted <= budget),
own AS (SELECT DISTINCT a.tier, a.example_id, a.nano - b.nano AS dq, a.pico - b.pico AS dc,
    (2 * (a.nano - b.nano) * 10000000000000000000000000000::HUGEINT + (a.pico - b.pico)) // (2 * (a.pico - b.pico)) AS key
  FROM aff a JOIN aff b USING (tier, example_id) WHERE a.pico > b.pico AND a.nano >= b.nano
  UNION SELECT tier, example_id, 0, 1, 0 FROM aff),
pts1 AS (SELECT tier, example_id, key, min(dq) AS dq, arg_min(dc, dq) AS dc FROM own GROUP BY tier, example_id, key),
win AS (SELECT p.tier, p.example_id, p.key, p.dq * 1000 AS num, p.dc AS den, a.domain, a.model_id, a.q, a.realized, CAST(a.realized > a.budget AS INT) AS bad
  FROM pts1 p JOIN aff a USING (tier, example_id)
  QUALIFY row_number() OVER (PARTITION BY p.tier, p.example_id, p.key ORDER BY p.dc * a.nano - p.dq * a.pico DESC, a.quoted, a.model_id) = 1),
chg AS (SELECT *, q - coalesce(lag(q) OVER w, 0) AS xq, realized - coalesce(lag(realized) OVER w, 0) AS xc, bad - coalesce(lag(bad) OVER w, 0) AS xb,
    key = 0 OR model_id <> lag(model_id) OVER w AS moved FROM win WINDOW w AS (PARTITION BY tier, example_id ORDER BY key)),
none AS (SELECT tier, example_id, any_value(domain) AS domain FROM sc GROUP BY tier, example_id HAVING min(quoted) > any_value(budget)),
ev AS (SELECT tier, domain, key, num::DOUBLE / den::DOUBLE AS lam, xq, xc, xb FROM chg WHERE moved
  UNION ALL SELECT tier, domain, 0, 0, 0, 0, 1 FROM none)"""


@query("lambda_curve", "L6", f"""WITH {scored_sql(TIGHT_BUDGETS)}, {_SWEEP},
g AS (SELECT tier, key, any_value(lam) AS lam, sum(xq) AS xq, sum(xc) AS xc, sum(xb) AS xb FROM ev GROUP BY tier, key)
SELECT tier, round(lam, 9) AS lam, CAST(sum(xq) OVER w AS BIGINT) AS q_milli, CAST(sum(xc) OVER w AS BIGINT) AS spend_micro, CAST(sum(xb) OVER w AS BIGINT) AS n_infeasible
FROM g WINDOW w AS (PARTITION BY tier ORDER BY key)""")
def lambda_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality, spend and infeasible count as functions of lambda, tight budgets."""

    rows = lambdas.log_rows(predicted_log(spark, sf_dir), tiers(TIGHT_BUDGETS))
    return shown_curve(lambdas.curve(lambdas.change_events(rows, []), []))


def shown_curve(c: DataFrame, by: list[str] | None = None) -> DataFrame:
    return c.select(
        *(by or []), "tier", F.round(lambdas.lambda_value(F.col("num"), F.col("den")), 9).alias("lam"),
        (F.col("quality_sum") * 1000).cast("bigint").alias("q_milli"), micro(F.col("spend")).alias("spend_micro"), "n_infeasible",
    )


GRID = [(0, 1), (1, 20), (1, 10), (1, 5), (3, 10), (1, 2), (3, 4), (1, 1), (2, 1), (5, 1)]
_GRID_VALUES = ", ".join(f"({n}, {d})" for n, d in GRID)


@query("lambda_grid_scores", "L5 L6", f"""WITH {scored_sql(TIGHT_BUDGETS)}, grid(num, den) AS (VALUES {_GRID_VALUES}),
w AS (SELECT num, den, tier, example_id, q, realized, realized > budget AS bad FROM sc, grid WHERE quoted <= budget
  QUALIFY row_number() OVER (PARTITION BY num, den, tier, example_id ORDER BY den * 1000 * nano - num * pico DESC, quoted, model_id) = 1)
SELECT tier, round(num::DOUBLE / den, 9) AS lam, CAST(sum(q) AS BIGINT) AS q_milli, CAST(sum(realized) AS BIGINT) AS spend_micro, count(*) FILTER (bad) AS n_infeasible FROM w GROUP BY tier, num, den""")
def lambda_grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given grid read off the curve; the SQL replays every grid value."""

    rows = lambdas.log_rows(predicted_log(spark, sf_dir), tiers(TIGHT_BUDGETS))
    curve = lambdas.curve(lambdas.change_events(rows, []), [])
    grid = spark.createDataFrame([(t.tier, n, d) for t in tiers() for n, d in GRID], "tier string, num bigint, den bigint")
    grid = grid.withColumn("key", lambdas.fraction_key(F.col("num"), F.col("den")))
    return shown_curve(lambdas.at_grid(curve, grid, []))


@query("lambda_selection", "L6 L7 L11", f"""WITH {scored_sql()}, {_SWEEP}, folds AS (SELECT DISTINCT lang AS held_out FROM documents),
g AS (SELECT held_out, tier, key, any_value(lam) AS lam, sum(xq) AS xq, sum(xc) AS xc, sum(xb) AS xb FROM ev JOIN folds ON domain <> held_out GROUP BY ALL),
c AS (SELECT held_out, tier, key, lam, sum(xq) OVER w AS q, sum(xc) OVER w AS spend, sum(xb) OVER w AS bad FROM g WINDOW w AS (PARTITION BY held_out, tier ORDER BY key))
SELECT held_out, tier, round(lam, 9) AS lam, CAST(q AS BIGINT) AS q_milli, CAST(spend AS BIGINT) AS spend_micro FROM c WHERE bad = 0
QUALIFY row_number() OVER (PARTITION BY held_out, tier ORDER BY q DESC, spend, key) = 1""")
def lambda_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lambda per held-out domain and tier, searched on the other domains."""

    log = predicted_log(spark, sf_dir)
    train = with_folds(log, domain_list(log)).where("role = 'train'")
    events = lambdas.change_events(lambdas.log_rows(train, tiers()), ["held_out"])
    best = lambdas.select_best(lambdas.curve(events, ["held_out"]), ["held_out"])
    return best.select(
        "held_out", "tier", F.round(lambdas.lambda_value(F.col("num"), F.col("den")), 9).alias("lam"),
        (F.col("quality_sum") * 1000).cast("bigint").alias("q_milli"), micro(F.col("spend")).alias("spend_micro"),
    )


POOL_GRID = [(0, 1), (1, 5), (1, 2), (1, 1)]
POOLED = {"fast": 12000000, "balanced": 30000000, "premium": 60000000}
_POOL_VALUES = ", ".join(f"({n}, {d})" for n, d in POOL_GRID)


def _pool_sql(grid: str, meet: str) -> str:
    """Every grid value of every ledger replayed call by call, then the best feasible one."""

    return f"""WITH RECURSIVE {scored_sql(POOLED)}, {grid},
cand AS (SELECT tag, tier, ord, any_value(budget) AS budget, row_number() OVER (PARTITION BY tag, tier ORDER BY ord) AS rn,
  list({{'id': model_id, 'quoted': quoted, 'realized': realized, 'q': q, 'nano': nano, 'pico': pico}} ORDER BY quoted) AS c FROM sc GROUP BY tag, tier, ord),
ranked AS (SELECT num, den, tag, tier, rn, budget, list_sort(list_transform(c, lambda v: {{'u': -(den * 1000 * v.nano - num * v.pico), 'quoted': v.quoted, 'id': v.id, 'realized': v.realized, 'q': v.q}})) AS c FROM cand {meet}),
run AS (
  SELECT num, den, tag, tier, CAST(0 AS BIGINT) AS rn, CAST(any_value(budget) AS BIGINT) AS balance, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS spend, CAST(0 AS BIGINT) AS bad FROM ranked GROUP BY num, den, tag, tier
  UNION ALL
  SELECT num, den, tag, tier, rn, CASE WHEN m IS NULL THEN balance WHEN m.realized > balance THEN 0 ELSE balance - m.realized END,
    q + CASE WHEN m.realized <= balance THEN m.q ELSE 0 END, spend + coalesce(m.realized, 0), bad + CASE WHEN m IS NULL OR m.realized > balance THEN 1 ELSE 0 END
  FROM (SELECT r.num, r.den, r.tag, r.tier, s.rn, r.balance, r.q, r.spend, r.bad, list_filter(s.c, lambda v: v.quoted <= r.balance)[1] AS m
    FROM run r JOIN ranked s ON s.num = r.num AND s.den = r.den AND s.tag = r.tag AND s.tier = r.tier AND s.rn = r.rn + 1)),
done AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY num, den, tag, tier ORDER BY rn DESC) = 1)
SELECT tag, tier, round(num::DOUBLE / den, 9) AS lam, q AS q_milli, spend AS spend_micro FROM done WHERE bad = 0
QUALIFY row_number() OVER (PARTITION BY tag, tier ORDER BY q DESC, spend, num::DOUBLE / den) = 1"""


@query("cumulative_lambda_tuning", "L8 R3 J7", _pool_sql(f"grid(num, den) AS (VALUES {_POOL_VALUES})", ", grid"))
def cumulative_lambda_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best grid value per source and tier when the source's queries share one budget."""

    log = predicted_log(spark, sf_dir).withColumn("tag", F.col("observable_tag"))
    best = lambdas.tune_cumulative(log, tiers(POOLED), POOL_GRID, ["tag"])
    return best.select(
        "tag", "tier", F.round(lambdas.lambda_value(F.col("num"), F.col("den")), 9).alias("lam"),
        (F.col("quality_sum") * 1000).cast("bigint").alias("q_milli"), micro(F.col("spend")).alias("spend_micro"),
    )


# Brute force: zero and every root of two models of one prompt.
_POOL_ROOTS = """aff AS (SELECT * FROM sc WHERE quoted <= budget),
rt AS (SELECT a.tag, a.tier, a.nano - b.nano AS dq, a.pico - b.pico AS dc,
    (2 * (a.nano - b.nano) * 10000000000000000000000000000::HUGEINT + (a.pico - b.pico)) // (2 * (a.pico - b.pico)) AS key
  FROM aff a JOIN aff b USING (tag, tier, example_id) WHERE a.pico > b.pico AND a.nano >= b.nano),
grid AS (SELECT tag, tier, min(dq) * 1000 AS num, arg_min(dc, dq) AS den FROM rt GROUP BY tag, tier, key UNION ALL SELECT DISTINCT tag, tier, 0, 1 FROM sc)"""


@query("shared_budget_lambda", "L8 R3 J7", _pool_sql(_POOL_ROOTS, "JOIN grid USING (tag, tier)"))
def shared_budget_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of all lambdas per source and tier when the source's queries share one budget; the SQL tries every root."""

    log = predicted_log(spark, sf_dir).withColumn("tag", F.col("observable_tag"))
    best = tuning.tune_shared_budget(log, tiers(POOLED), ["tag"])
    return best.select(
        "tag", "tier", F.round(lambdas.lambda_value(F.col("num"), F.col("den")), 9).alias("lam"),
        (F.col("quality_sum") * 1000).cast("bigint").alias("q_milli"), micro(F.col("spend")).alias("spend_micro"),
    )
