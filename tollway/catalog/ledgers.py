"""Shared budgets over ordered call logs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.catalog.baselines import SQL_PICKS
from tollway.catalog.registry import query, table
from tollway.catalog.sample import DENSE_BUDGETS, PREMIUM, TIGHT_BUDGETS, dense_log, sql_log, tiers
from tollway.functions.costs import micro
from tollway.operators import metrics, policies
from tollway.operators.ledger import cumulative, multi_call, sequential_replay, visible
from tollway.schema import cost_lit, with_tiers

POOL_BUDGETS = {"fast": 4000000, "balanced": 9000000, "premium": 20000000}


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("value").cast("decimal(28,12)").alias("cost")
    )


EVENTS_SQL = """WITH c AS (SELECT user_id, event_id, ts, CAST(value AS DECIMAL(28,12)) AS cost FROM events),
s AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM c)"""


@query("cumulative_ledger", "R2 W2 A15", EVENTS_SQL + """
SELECT user_id, event_id, CAST(round(spent * 1000000) AS BIGINT) AS spent_micro, CAST(round(greatest(1000 - spent, 0) * 1000000) AS BIGINT) AS remaining_micro,
  spent > 1000 AND cost > 0 AS over FROM s""")
def cumulative_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cumulative(event_calls(spark, sf_dir), ["user_id"], "at", "cost", cost_lit(1000), tie_break=["event_id"])
    return r.select("user_id", "event_id", micro(F.col("spent")).alias("spent_micro"), micro(F.col("remaining_after")).alias("remaining_micro"), "over")


@query("ledger_report", "R2 A7", EVENTS_SQL + """
SELECT user_id, count(*) AS n_calls, count(*) FILTER (spent > 1000 AND cost > 0) AS over_calls, CAST(round(max(spent) * 1000000) AS BIGINT) AS spent_micro FROM s GROUP BY user_id""")
def ledger_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cumulative(event_calls(spark, sf_dir), ["user_id"], "at", "cost", cost_lit(1000), tie_break=["event_id"])
    return r.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if("over").alias("over_calls"), micro(F.max("spent")).alias("spent_micro")
    )


# One row at a time per ledger: the recurrence itself.
SEQUENTIAL_SQL = f"""WITH RECURSIVE {sql_log(POOL_BUDGETS)},
rows AS (SELECT tag, tier, budget, example_id, ord, any_value(prompt) AS prompt, row_number() OVER (PARTITION BY tag, tier ORDER BY ord) AS rn
  FROM lt GROUP BY tag, tier, budget, example_id, ord),
cand AS (SELECT tag, tier, ord, list({{'id': model_id, 'quoted': quoted, 'realized': realized, 'q': q}} ORDER BY model_id) AS c FROM lt GROUP BY tag, tier, ord),
pol(policy) AS (VALUES ('always-cheapest'), ('always-premium'), ('random')),
seq AS (SELECT policy, r.tag, r.tier, r.ord, r.rn, r.budget, r.example_id, c,
  ('0x' || substr(sha256('2026' || chr(0) || prompt || chr(0) || r.tier), 1, 16))::UBIGINT AS u
  FROM rows r JOIN cand USING (tag, tier, ord) CROSS JOIN pol),
pick0 AS (SELECT 1),
run AS (
  SELECT policy, tag, tier, CAST(0 AS BIGINT) AS rn, CAST(any_value(budget) AS BIGINT) AS balance, NULL::VARCHAR AS example_id, NULL::VARCHAR AS decision,
    FALSE AS made, FALSE AS feasible, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS before FROM seq GROUP BY policy, tag, tier
  UNION ALL
  SELECT policy, tag, tier, rn,
    CASE WHEN m.quoted > before THEN before WHEN m.realized > before THEN 0 ELSE before - m.realized END AS balance,
    example_id, m.id, m.quoted <= before, m.quoted <= before AND m.realized <= before, CASE WHEN m.quoted <= before THEN m.realized ELSE 0 END, before
  FROM (SELECT s.policy, s.tag, s.tier, s.rn, s.example_id, p.balance AS before,
      CASE s.policy WHEN 'always-cheapest' THEN s.c[1] WHEN 'always-premium' THEN s.c[5]
        ELSE CASE WHEN len(list_filter(s.c, lambda v: v.quoted <= p.balance)) = 0 THEN s.c[1]
          ELSE list_filter(s.c, lambda v: v.quoted <= p.balance)[CAST(u % len(list_filter(s.c, lambda v: v.quoted <= p.balance)) AS BIGINT) + 1] END END AS m
    FROM run p JOIN seq s ON s.policy = p.policy AND s.tag = p.tag AND s.tier = p.tier AND s.rn = p.rn + 1))
SELECT policy, tag, tier, example_id, decision, made AS call_made, feasible, cost AS cost_micro, before AS before_micro, balance AS after_micro FROM run WHERE rn > 0"""


@query("sequential_ledger", "R3 R2 P9", SEQUENTIAL_SQL)
def sequential_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled budget per source: what is left decides the next choice."""

    log = dense_log(spark, sf_dir).withColumn("tag", F.col("observable_tag"))
    chosen = [policies.always_cheapest(), policies.always_premium(PREMIUM), policies.seeded_random()]
    r = sequential_replay(log, tiers(POOL_BUDGETS), chosen, ["tag"])
    return r.select(
        "policy", "tag", "tier", "example_id", "decision", "call_made", "feasible", micro(F.col("cost")).alias("cost_micro"),
        micro(F.col("remaining_before")).alias("before_micro"), micro(F.col("remaining_after")).alias("after_micro"),
    )


@query("multi_call_queries", "R5", f"""WITH {sql_log(DENSE_BUDGETS)}, k AS (SELECT *, row_number() OVER (PARTITION BY tier, example_id ORDER BY rk) AS idx FROM lt),
b AS (SELECT *, greatest(budget - coalesce(sum(realized) OVER w, 0), 0) AS before FROM k WINDOW w AS (PARTITION BY tier, example_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, quoted > before OR idx > 5 AS refused, quoted <= before AND realized > before AS over FROM b),
st AS (SELECT *, coalesce(bool_or(refused OR over) OVER (PARTITION BY tier, example_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS stopped FROM f)
SELECT tier, example_id, count(*) FILTER (NOT stopped AND NOT refused) AS n_calls, CAST(coalesce(sum(realized) FILTER (NOT stopped AND NOT refused), 0) AS BIGINT) AS cost_micro,
  bool_and(NOT stopped AND NOT refused AND NOT over) AS feasible,
  CASE WHEN bool_and(NOT stopped AND NOT refused AND NOT over) THEN max(model_id) FILTER (idx = 5) END AS selected_model_id FROM st GROUP BY tier, example_id""")
def multi_call_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalating calls of all five candidates per query, the last one's output kept."""

    rows = with_tiers(dense_log(spark, sf_dir), tiers())
    calls = rows.select(F.lit("cascade").alias("policy"), "tier", "budget", "example_id", F.posexplode("models").alias("call_idx", "m"))
    calls = calls.select("policy", "tier", "budget", "example_id", "call_idx", "m.model_id", "m.quoted", "m.realized", "m.quality", (F.col("call_idx") == 4).alias("selected"))
    r = multi_call(calls, max_calls=5)
    return r.select("tier", "example_id", "n_calls", micro(F.col("cost")).alias("cost_micro"), "feasible", "selected_model_id")


@query("running_retention", "W3", f"""WITH {sql_log()}, picks AS ({SQL_PICKS['always-cheapest']} UNION ALL {SQL_PICKS['oracle']}),
p AS (SELECT tier, ord, max(realized) FILTER (policy = 'always-cheapest') AS r, max(q) FILTER (policy = 'always-cheapest') AS q, max(q) FILTER (policy = 'oracle') AS o
  FROM picks JOIN lt USING (tier, example_id, model_id) GROUP BY tier, ord)
SELECT tier, ord, CAST(sum(r) OVER w AS BIGINT) AS cost_micro, CAST(sum(q) OVER w AS BIGINT) AS q_milli, CAST(sum(o) OVER w AS BIGINT) AS oracle_milli,
  round(CASE WHEN sum(o) OVER w <> 0 THEN sum(q) OVER w / sum(o) OVER w END, 9) AS retention FROM p WINDOW w AS (PARTITION BY tier ORDER BY ord)""")
def running_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = retention_steps(dense_log(spark, sf_dir))
    r = metrics.running_retention(steps, ["tier"], "ord")
    return r.select(
        "tier", "ord", micro(F.col("running_cost")).alias("cost_micro"), (F.col("running_quality") * 1000).cast("bigint").alias("q_milli"),
        (F.col("running_oracle") * 1000).cast("bigint").alias("oracle_milli"), F.round("retention", 9).alias("retention"),
    )


def retention_steps(log: DataFrame) -> DataFrame:
    """Cheapest call next to the oracle call, per tier and row, without a join."""

    rows = with_tiers(log, tiers())
    view = visible(rows, F.col("budget"))
    pick = policies.cheapest_of(view.candidates)
    best = policies.oracle().choose(view, F.col("models"))
    hit = lambda c: F.try_element_at(F.filter("models", lambda m: m["model_id"] == c), F.lit(1))
    return rows.withColumns({"_a": hit(pick), "_b": hit(best)}).select(
        "tier", "ord", F.col("_a.realized").alias("realized"), F.col("_a.quality").alias("quality"), F.col("_b.quality").alias("oracle_quality")
    )


@query("ledger_balance_by_tier", "R1 R2 A7", f"""WITH {sql_log(TIGHT_BUDGETS)}, c AS (SELECT tier, ord, realized, budget * 100 AS pool,
  sum(realized) OVER (PARTITION BY tier ORDER BY ord) AS spent FROM lt WHERE rk = 2)
SELECT tier, ord, CAST(spent AS BIGINT) AS spent_micro, CAST(greatest(pool - spent, 0) AS BIGINT) AS remaining_micro, spent > pool AND realized > 0 AS over FROM c""")
def ledger_balance_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger per tier holds a third of all calls; its running total is still spread out."""

    rows = with_tiers(dense_log(spark, sf_dir), tiers(TIGHT_BUDGETS))
    calls = rows.select("tier", "ord", (F.col("budget") * Decimal(100)).cast("decimal(28,12)").alias("pool"), F.element_at("models", 2)["realized"].alias("cost"))
    r = cumulative(calls, ["tier"], "ord", "cost", F.col("pool"))
    return r.select("tier", "ord", micro(F.col("spent")).alias("spent_micro"), micro(F.col("remaining_after")).alias("remaining_micro"), "over")


