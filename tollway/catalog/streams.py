"""Streaming jobs run to the end of the given tables."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.catalog.learned import catalogue, shown_nano
from tollway.catalog.learned_sql import trained_sql
from tollway.catalog.ledgers import EVENTS_SQL, retention_steps
from tollway.catalog.prompts import DEMO_SQL
from tollway.catalog.registry import query, table
from tollway.catalog.sample import dense_log, sql_log, tiers
from tollway.functions.costs import micro
from tollway.plans import benchmark
from tollway.plans.route import route
from tollway.plans.train import train
from tollway.session import materialize, scratch_path
from tollway.streaming import budgets
from tollway.streaming.epochs import EpochTables
from tollway.streaming.retention import RetentionStream
from tollway.streaming.route import FittedRouting, release, routed, start_routing


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream, whether it is one file or a folder of part files."""

    # a stream lists folders; the glob keeps a single file as it is
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}[.]parquet")


@query("stream_route_prompts", "ST1 B11 B12", f"""WITH {sql_log()}, {DEMO_SQL}
SELECT example_id, tier, model_id AS decision, quoted AS quoted_micro FROM demo_q CROSS JOIN tiers WHERE quoted <= budget
QUALIFY row_number() OVER (PARTITION BY example_id, tier ORDER BY
  (CASE tier WHEN 'fast' THEN 5 WHEN 'balanced' THEN 20 ELSE 25 END)::HUGEINT * 1000 * nano - (CASE tier WHEN 'fast' THEN 4 WHEN 'balanced' THEN 7 ELSE 2 END)::HUGEINT * quoted * 1000000 DESC, quoted, model_id) = 1""")
def stream_route_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = stream_of(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("example_id"), F.col("text").alias("prompt"))
    decisions = route(prompts, catalogue(), tiers(), keep=["example_id"])
    path = scratch_path(spark, "routed")
    start_routing(decisions, path, scratch_path(spark, "routed-progress")).awaitTermination()
    return routed(spark, path, decisions.schema).select("example_id", "tier", "decision", micro(F.col("quoted")).alias("quoted_micro"))


@query("stream_route_fitted", "ST1 K6 S8 S11 B9", trained_sql())
def stream_route_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, routed by a released predictor that was trained on them."""

    path, releases = scratch_path(spark, "trained-for-stream"), scratch_path(spark, "releases")
    train(dense_log(spark, sf_dir), tiers(), benchmark.LinearConfig(), path)
    release(spark, releases, path)
    prompts = stream_of(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("example_id"), F.col("text").alias("prompt"))
    job = FittedRouting(releases, catalogue(), tiers(), scratch_path(spark, "routed-fitted"), ["example_id"])
    job.start(prompts, scratch_path(spark, "routed-fitted-progress")).awaitTermination()
    return job.decisions(spark).select("example_id", "tier", "decision", micro(F.col("quoted")).alias("quoted_micro"), shown_nano())


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: the charge is the value, the quote zero."""

    cost = F.col("value").cast("decimal(28,12)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ledger_key"), F.col("event_id").cast("string").alias("call_id"),
        F.col("ts").cast("timestamp").alias("at"), F.lit(0).cast("decimal(28,12)").alias("quoted"), cost.alias("realized"),
    )


def run_ledger(spark: SparkSession, batches: list[DataFrame], limit: Decimal, delay: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """Calls that arrive batch by batch, each settled by a stream that goes on from the checkpoint.

    A last call of no ledger, far in the future, moves the clock past all others.
    """

    folder, path, progress = (scratch_path(spark, name) for name in ("arrivals", "settled", "ledger-progress"))
    tick = spark.createDataFrame([(None, None, datetime(2200, 1, 1), None, None)], budgets.CALL_FIELDS)
    for batch in [*batches, tick]:
        batch.select(*tick.columns).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(tick.schema).parquet(folder)
        budgets.start(budgets.settle_stream(stream, limit, delay, keep), path, progress).awaitTermination()
    return budgets.settled_calls(spark, path)


@query("stream_ledger", "ST2 R2", EVENTS_SQL + """
SELECT CAST(user_id AS VARCHAR) AS ledger_key, CAST(event_id AS VARCHAR) AS call_id, FALSE AS late,
  CAST(round(greatest(1000 - spent, 0) * 1000000) AS BIGINT) AS remaining_micro, spent > 1000 AND cost > 0 AS over FROM s""")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call accepted (its quote is zero), so the result is the closed form."""

    return run_ledger(spark, [event_calls(spark, sf_dir)], Decimal(1000)).select("ledger_key", "call_id", "late", micro(F.col("remaining_after")).alias("remaining_micro"), "over")


@query("stream_ledger_rejections", "ST2 R3 P9", """WITH RECURSIVE c AS (SELECT user_id, event_id, CAST(round(CAST(value AS DECIMAL(28,12)) * 1000000) AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
run AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, NULL::BIGINT AS event_id, CAST(300000000 AS BIGINT) AS before, CAST(300000000 AS BIGINT) AS balance, FALSE AS accepted FROM c GROUP BY user_id
  UNION ALL SELECT c.user_id, c.rn, c.event_id, r.balance, CASE WHEN c.cost > r.balance THEN r.balance ELSE r.balance - c.cost END, c.cost <= r.balance
  FROM run r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)
SELECT CAST(user_id AS VARCHAR) AS ledger_key, CAST(event_id AS VARCHAR) AS call_id, accepted, before AS before_micro, balance AS remaining_micro FROM run WHERE rn > 0""")
def stream_ledger_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes equal charges, so a call that no longer fits is refused and smaller ones still pass."""

    calls = event_calls(spark, sf_dir).withColumn("quoted", F.col("realized"))
    return run_ledger(spark, [calls], Decimal(300)).select(
        "ledger_key", "call_id", "accepted", micro(F.col("remaining_before")).alias("before_micro"), micro(F.col("remaining_after")).alias("remaining_micro")
    )


SLICES = 4


@query("stream_ledger_late", "ST2 R3 P9", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS us, CAST(round(CAST(value AS DECIMAL(28,12)) * 1000000) AS BIGINT) AS cost FROM events),
placed AS (SELECT e.*, (us - lo) * {SLICES} // (hi - lo + 1) + CASE WHEN event_id % 100 = 7 THEN 1 ELSE 0 END AS slice FROM e, (SELECT min(us) AS lo, max(us) AS hi FROM e)),
clock AS (SELECT slice, max(max(us)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - 600000000 AS watermark FROM placed GROUP BY slice),
marked AS (SELECT user_id, event_id, us, cost, coalesce(us < watermark, FALSE) AS late FROM placed JOIN clock USING (slice)),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, CAST(event_id AS VARCHAR)) AS rn FROM marked WHERE NOT late),
run AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, NULL::BIGINT AS event_id, CAST(300000000 AS BIGINT) AS before, CAST(300000000 AS BIGINT) AS balance, FALSE AS accepted FROM c GROUP BY user_id
  UNION ALL SELECT c.user_id, c.rn, c.event_id, r.balance, CASE WHEN c.cost > r.balance THEN r.balance ELSE r.balance - c.cost END, c.cost <= r.balance
  FROM run r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)
SELECT CAST(user_id AS VARCHAR) AS ledger_key, CAST(event_id AS VARCHAR) AS call_id, FALSE AS late, accepted, before AS before_micro, balance AS remaining_micro FROM run WHERE rn > 0
UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), TRUE, FALSE, NULL, NULL FROM marked WHERE late""")
def stream_ledger_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in four batches: one in a hundred arrives a batch later, one in forty comes twice, order within a batch is any."""

    calls = event_calls(spark, sf_dir).withColumn("quoted", F.col("realized"))
    micros, number = F.unix_micros("at"), F.col("call_id").cast("bigint")
    ends = calls.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi")).first()
    part = F.floor((micros - F.lit(ends["lo"])) * SLICES / F.lit(ends["hi"] - ends["lo"] + 1)) if ends["lo"] is not None else F.lit(0)
    placed = calls.withColumn("slice", part + F.when(number % 100 == 7, 1).otherwise(0))
    twice = placed.where(number % 40 == 3).withColumn("slice", F.col("slice") + 1)
    arrivals = materialize(placed.unionByName(twice), "arrivals-by-batch", ["slice"])
    batches = [arrivals.where(F.col("slice") == k) for k in range(SLICES + 1)]
    return run_ledger(spark, batches, Decimal(300), keep="1000 days").select(
        "ledger_key", "call_id", "late", "accepted", micro(F.col("remaining_before")).alias("before_micro"), micro(F.col("remaining_after")).alias("remaining_micro")
    )


@query("stream_retention", "ST3 W3", f"""WITH {sql_log()}, o AS (SELECT tier, ord, min(-q * 100000000 + realized) AS k FROM lt WHERE quoted <= budget AND realized <= budget GROUP BY tier, ord),
b AS (SELECT lt.tier, lt.ord, max(q) AS oq FROM lt JOIN o ON o.tier = lt.tier AND o.ord = lt.ord AND -lt.q * 100000000 + lt.realized = o.k AND lt.quoted <= lt.budget GROUP BY lt.tier, lt.ord),
p AS (SELECT l.tier, l.ord, l.realized AS r, l.q, b.oq FROM lt l JOIN b ON b.tier = l.tier AND b.ord = l.ord WHERE rk = 1)
SELECT tier, ord, CAST(sum(r) OVER w AS BIGINT) AS cost_micro, round(CASE WHEN sum(oq) OVER w <> 0 THEN sum(q) OVER w / sum(oq) OVER w END, 9) AS retention FROM p WINDOW w AS (PARTITION BY tier ORDER BY ord)""")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollway.catalog.sample import sample_models

    d = stream_of(spark, sf_dir, "documents")
    log = d.select(
        F.col("doc_id").cast("string").alias("example_id"), F.col("doc_id").alias("ord"), F.col("text").alias("prompt"),
        F.col("lang").alias("domain"), F.col("source").alias("observable_tag"), sample_models(F.col("doc_id"), F.col("n_chars")).alias("models"),
    )
    job = RetentionStream(EpochTables(scratch_path(spark, "retention")))
    job.start(retention_steps(log), scratch_path(spark, "retention-progress")).awaitTermination()
    return job.steps(spark).select("tier", "ord", micro(F.col("running_cost")).alias("cost_micro"), F.round("retention", 9).alias("retention"))
