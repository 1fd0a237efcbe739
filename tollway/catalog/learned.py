"""Fitted predictors, calibration, benchmarks and deployable policies."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.catalog.learned_sql import (
    CALIBRATED_SQL, EMBEDDED_RAW_SQL, RAW_SQL, RIDGE_SQL, VECTOR_WIDTH, benchmark_sql, capped_sql, of_vector_documents,
    stump_sql, trained_sql,
)
from tollway.catalog.logs import EVAL_CASE, wide_log
from tollway.catalog.prompts import DEMO_SQL, FEATURES_SQL
from tollway.catalog.registry import query, table
from tollway.catalog.sample import CATALOGUE, DENSE_BUDGETS, dense_log, predicted_log, sql_log, tiers
from tollway.catalog.baselines import CARD_SQL, HELD_OUT_SQL, SIX, SQL_GAP, rounded, shown_card, sql_results
from tollway.functions.costs import micro
from tollway.functions.surface import prompt_hash
from tollway.operators import checks, isotonic, metrics, policies, predict, ridge, stumps
from tollway.operators.scoring import StumpScorer
from tollway.operators.views import label_view
from tollway.plans import benchmark, diagnostic, showcase
from tollway.plans.route import route
from tollway.plans.train import train
from tollway.session import scratch_path
from tollway.sources import artifacts, scorecards
from tollway.sources import embeddings as vectors

ROUNDS = stumps.ROUNDS
VECTOR_IDENTITY = vectors.EmbeddingIdentity("table", "embeddings", "1", "none", False, "0" * 64, VECTOR_WIDTH)


def blurred_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mask 0, model_pos, ub, y, n) from scores SQL can reproduce."""

    log = predicted_log(spark, sf_dir)
    rows = F.arrays_zip("predicted", "models")
    long = log.select("example_id", F.posexplode(rows).alias("model_pos", "r"))
    return long.select(
        "example_id", F.lit(0).alias("mask"), "model_pos", (F.col("r.predicted") / 1e9).alias("ub"),
        F.col("r.models.quality").cast("double").alias("y"), F.lit(1.0).alias("n"),
    )


# Largest-smallest mean form of the monotone fit over distinct scores.
_MONOTONE = f"""WITH {sql_log()}, p AS (SELECT rk - 1 AS pos, (q * 500000 + blur * 1000000) AS s, q FROM long),
g AS (SELECT pos, s, sum(q) AS y, count(*) AS n, row_number() OVER (PARTITION BY pos ORDER BY s) AS i FROM p GROUP BY pos, s),
c AS (SELECT *, sum(y) OVER w AS cy, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY pos ORDER BY i)),
ab AS (SELECT a.pos, a.i AS a, b.i AS b, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.pos = b.pos AND b.i >= a.i),
lowest AS (SELECT pos, a, b, min(mean) OVER (PARTITION BY pos, a ORDER BY b DESC) AS low FROM ab),
fit AS (SELECT pos, b AS i, max(low) / 1000.0 AS value FROM lowest GROUP BY pos, b)"""
_MONOTONE_SQL = _MONOTONE + """
SELECT l.example_id, CAST(l.rk - 1 AS INT) AS model_pos, round(f.value, 6) AS calibrated FROM long l
JOIN g ON g.pos = l.rk - 1 AND g.s = l.q * 500000 + l.blur * 1000000 JOIN fit f ON f.pos = g.pos AND f.i = g.i"""


@query("isotonic_calibration", "M7 M8 J8 J15", _MONOTONE_SQL)
def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps fitted range by range, then looked up with the distributed nearest-step join."""

    pairs = blurred_pairs(spark, sf_dir)
    steps = isotonic.fit(pairs)
    scores = pairs.withColumnRenamed("ub", "score")
    out = isotonic.apply_steps(scores, steps)
    return out.select("example_id", "model_pos", F.round("value", 6).alias("calibrated"))


@query("isotonic_steps", "M7", _MONOTONE + """
SELECT CAST(pos AS INT) AS model_pos, round(min(value), 6) AS lowest, round(max(value), 6) AS highest FROM fit GROUP BY pos""")
def isotonic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = isotonic.fit(blurred_pairs(spark, sf_dir))
    return steps.groupBy("model_pos").agg(F.round(F.min("value"), 6).alias("lowest"), F.round(F.max("value"), 6).alias("highest"))


def prepared(spark: SparkSession, sf_dir: str) -> benchmark.Prepared:
    return benchmark.prepare_fits(dense_log(spark, sf_dir), tiers())


@query("stump_first_split", "M10 W6", f"""WITH {sql_log()}, {FEATURES_SQL}, f AS (SELECT doc_id, lang, unnest(x) AS v, unnest(range(12)) AS feature FROM feat),
h AS (SELECT DISTINCT lang AS held_out FROM documents),
t AS (SELECT held_out, rk - 1 AS pos, ord, q / 1000.0::DOUBLE - avg(q / 1000.0::DOUBLE) OVER (PARTITION BY held_out, rk) AS r FROM long JOIN h ON domain <> held_out),
s AS (SELECT held_out, pos, feature, v, sum(r) AS r, count(*) AS n FROM t JOIN f ON f.doc_id = t.ord GROUP BY ALL),
w AS (SELECT *, sum(r) OVER o - r AS l, sum(n) OVER o - n AS nl, sum(r) OVER p AS tr, sum(n) OVER p AS tn FROM s
  WINDOW o AS (PARTITION BY held_out, pos, feature ORDER BY v), p AS (PARTITION BY held_out, pos, feature)),
g AS (SELECT *, l * l / nl + (tr - l) * (tr - l) / (tn - nl) - tr * tr / tn AS gain FROM w WHERE nl >= 2 AND tn - nl >= 2)
SELECT held_out, CAST(pos AS INT) AS model_pos, CAST(feature AS INT) AS feature, round(v, 6) AS split, round(l / nl, 6) AS left_value, round((tr - l) / (tn - nl), 6) AS right_value FROM g
QUALIFY row_number() OVER (PARTITION BY held_out, pos ORDER BY round(gain, 10) DESC, feature, v) = 1""")
def stump_first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First boosting split of every outer training side and model."""

    p = prepared(spark, sf_dir)
    scorer = stumps.fit(p.cells, p.by_domain, p.plan, p.plan.masks(1), rounds=1)
    rows = [
        (p.plan.excluded(m)[0], k, *chain[0]) for m, chains in scorer.stumps.items() for k, chain in enumerate(chains) if chain
    ]
    out = spark.createDataFrame(rows, "held_out string, model_pos int, feature int, split double, left_value double, right_value double")
    return rounded(out)


@query("stump_scores", "M10 M11 M12", stump_sql(ROUNDS) + """
SELECT CAST(doc_id AS VARCHAR) AS example_id, lang AS domain, CAST(mask AS INT) AS mask, CAST(mp AS INT) AS model_pos, round(s, 6) AS score FROM raw WHERE bit_count(mask) = 1""")
def stump_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out raw scores of short stump chains for every row."""

    p = prepared(spark, sf_dir)
    scorer = stumps.fit(p.cells, p.by_domain, p.plan, p.plan.masks(1), rounds=ROUNDS)
    return rounded(shown_scores(p, scorer, p.plan.masks(1)))


def shown_scores(p: benchmark.Prepared, scorer, masks: list[int]) -> DataFrame:
    rows = predict.raw_scores(p.features.select("example_id", "domain", "x"), p.plan, scorer, masks)
    return rows.select("example_id", "domain", "mask", F.posexplode("scores").alias("model_pos", "score"))


@query("ridge_coefficients", "M3 M5 K7", RIDGE_SQL + """
SELECT CAST(mask AS INT) AS mask, CAST(mp AS INT) AS model_pos, CAST(i - 1 AS INT) AS feature, round(coef.w, 6) + 0.0 AS weight, round(bias, 6) AS bias FROM coef JOIN model USING (mask, mp) WHERE mask > 0""")
def ridge_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centered ridge fit per training subset and model."""

    p = prepared(spark, sf_dir)
    rows = ridge.fit_subsets(spark, p.by_domain, p.plan, p.plan.training_masks(), 1.0)
    out = rows.select("mask", "model_pos", F.posexplode("weights").alias("feature", "weight"), F.round("bias", 6).alias("bias"))
    return out.withColumn("weight", F.round("weight", 6) + F.lit(0.0))


@query("subset_scores", "M6 J11", RAW_SQL + """
SELECT CAST(doc_id AS VARCHAR) AS example_id, lang AS domain, CAST(mask AS INT) AS mask, CAST(mp AS INT) AS model_pos, round(s, 6) AS score FROM raw WHERE mask > 0""")
def subset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row scored by every subset that left its domain out."""

    p = prepared(spark, sf_dir)
    scorer = benchmark.LinearConfig().fit_base(p, p.plan.training_masks())
    return rounded(shown_scores(p, scorer, p.plan.training_masks()))


@query("calibrated_predictions", "M9 M13 M14 J5 J9", CALIBRATED_SQL + """
SELECT CAST(doc_id AS VARCHAR) AS example_id, 'm' || CAST(mp + 1 AS VARCHAR) AS model_id, round(round(value * 1e9) / 1e9 + 1e-10, 8) AS predicted FROM pred WHERE ctx = (1 << pos)""")
def calibrated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-fitted table: each row predicted by the calibrated fit that never saw its domain."""

    p = prepared(spark, sf_dir)
    f = benchmark.fit(p, benchmark.LinearConfig(), [*p.plan.masks(1), *p.plan.masks(2)], p.plan.masks(1))
    pairs = predict.long_predictions(benchmark.held_out_predictions(p.features, p, f))
    want = p.features.select("example_id", F.explode("models").alias("m")).select("example_id", "m.model_id")
    checks.require_empty(checks.coverage(want, pairs, ["example_id", "model_id"]), "predictions do not cover the log")
    return pairs.select("example_id", "model_id", shown_nano())


def run_benchmark(spark: SparkSession, sf_dir: str, *families: str, cap: int | None = None) -> benchmark.Benchmark:
    known = {"bilinear": benchmark.LinearConfig(), "stumps": benchmark.StumpConfig(rounds=ROUNDS)}
    return benchmark.run(dense_log(spark, sf_dir), tiers(), {f: known[f] for f in families}, cap)


@query("benchmark_bilinear", "K2 K7 L10 B7 J7 U1", benchmark_sql() + ", " + SQL_GAP + CARD_SQL)
def benchmark_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_card(run_benchmark(spark, sf_dir, "bilinear").card)


@query("benchmark_stumps", "K3 M12 L10", benchmark_sql("stumps", stump_sql(ROUNDS)) + ", " + SQL_GAP + CARD_SQL)
def benchmark_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_card(run_benchmark(spark, sf_dir, "stumps").card)


@query("benchmark_capped", "K2 L3 L4 L5", capped_sql(32) + ", " + SQL_GAP + CARD_SQL)
def benchmark_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned benchmark with a bounded candidate set per fold and tier."""

    return shown_card(run_benchmark(spark, sf_dir, "bilinear", cap=32).card)


def _delta_sql() -> str:
    """Stumps minus bilinear per held-out domain, and over all of them (held_out null)."""

    measures = ["fast_quality", "balanced_quality", "premium_quality", "weighted_quality", "gap_recovery"]
    sides = {"l": benchmark_sql(), "r": benchmark_sql("stumps", stump_sql(ROUNDS))}
    names = {"l": "bilinear", "r": "stumps"}

    def rows(side: str, tail: str, key: str) -> str:
        # Fifteen digits: the difference is rounded, not its sides.
        return f"(SELECT {key}, {', '.join(measures)} FROM ({sides[side]}{tail.replace(', 6)', ', 15)')}) WHERE policy = '{names[side]}') {side}"

    deltas = ", ".join(f"round(r.{m} - l.{m}, 6) AS delta_{m}" for m in measures)
    held = f"SELECT l.held_out, {deltas} FROM {rows('l', HELD_OUT_SQL, 'held_out')} JOIN {rows('r', HELD_OUT_SQL, 'held_out')} ON l.held_out = r.held_out"
    card = ", " + SQL_GAP + CARD_SQL
    overall = f"SELECT NULL AS held_out, {deltas} FROM {rows('l', card, '1 AS k')} JOIN {rows('r', card, '1 AS k')} ON l.k = r.k"
    return f"{held} UNION ALL {overall}"


@query("compare_predictors", "K4 A21 A22", _delta_sql())
def compare_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stumps minus bilinear, overall and per held-out domain."""

    overall, held = benchmark.compare(run_benchmark(spark, sf_dir, "bilinear", "stumps"))
    return rounded(held.unionByName(overall.withColumn("held_out", F.lit(None).cast("string"))))


@query("paired_delta", "A22", f"""WITH {sql_log()}, c AS (SELECT domain, tier, CASE tier WHEN 'fast' THEN 0.5::DOUBLE WHEN 'balanced' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS w,
  avg(q) FILTER (rk = 1) / 1000.0 AS a, avg(q) FILTER (rk = 2) / 1000.0 AS b, bool_and(realized <= budget) FILTER (rk = 1) AS ok1, bool_and(realized <= budget) FILTER (rk = 2) AS ok2 FROM lt GROUP BY domain, tier)
SELECT domain AS held_out, round(max(b - a) FILTER (tier = 'fast'), 6) AS delta_fast_quality, round(max(b - a) FILTER (tier = 'balanced'), 6) AS delta_balanced_quality,
  round(max(b - a) FILTER (tier = 'premium'), 6) AS delta_premium_quality, round(sum(w * b) / sum(w) - sum(w * a) / sum(w), 6) AS delta_weighted_quality FROM c GROUP BY domain""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fixed policies compared per held-out domain."""

    from tollway.operators.ledger import replay

    results = replay(
        dense_log(spark, sf_dir), tiers(),
        [policies.always_cheapest(), policies.oracle(), policies.scheduled("second", F.lit("m2"))],
    )
    held = metrics.held_out_scores(results).withColumn(
        "policy", F.when(F.col("policy") == "second", "right").when(F.col("policy") == "always-cheapest", "left").otherwise(F.col("policy"))
    )
    return rounded(metrics.paired_delta(held, "left", "right", ["held_out"])).drop("delta_gap_recovery")


@query("scorecard_files", "S13 A23", sql_results(SIX) + ", " + SQL_GAP + CARD_SQL)
def scorecard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation's scorecard written as JSON lines and read back."""

    from tollway.plans.evaluate import evaluate

    return shown_card(scorecards.round_trip(evaluate(dense_log(spark, sf_dir), tiers()).card))


@query("train_and_route", "K5 K6 S8 S10 S11 S12 B11 M9 M13", trained_sql())
def train_and_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on all rows, save, verify against the data, load, and choose for every prompt."""

    log = dense_log(spark, sf_dir)
    path = scratch_path(spark, "trained")
    train(log, tiers(), benchmark.LinearConfig(), path)
    lambdas = artifacts.verify_policy(spark, f"{path}/policy", f"{path}/predictor", log, tiers())
    p = artifacts.load_predictor(spark, f"{path}/predictor")
    return route(log.select("example_id", "prompt"), catalogue(), tiers(), lambdas, p.scorer, p.calibrators, ["example_id"]).select(
        "example_id", "tier", "decision", micro(F.col("quoted")).alias("quoted_micro"), shown_nano()
    )


def prompt_vectors(spark: SparkSession, sf_dir: str) -> vectors.Embedded:
    """A vector for every prompt of the documents, written with its identity and read back."""

    raw = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    firsts = dense_log(spark, sf_dir).groupBy(prompt_hash(F.col("prompt")).alias("prompt_sha256")).agg(F.min("ord").alias("first_id"))
    placed = firsts.withColumn("vec_id", F.col("first_id") % F.lit(raw.count())).join(raw, "vec_id")
    path = scratch_path(spark, "vectors")
    vectors.save(vectors.Embedded(VECTOR_IDENTITY, placed), path)
    return vectors.load(spark, path)


@query("train_and_route_embedded", "S7 S8 S12 K5 K6 F8 J13", trained_sql(EMBEDDED_RAW_SQL))
def train_and_route_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor of surface and embedding features: fitted, saved with the vectors' identity, verified, loaded, routed."""

    log, embedded = dense_log(spark, sf_dir), prompt_vectors(spark, sf_dir)
    path = scratch_path(spark, "trained-embedded")
    train(log, tiers(), benchmark.LinearConfig(), path, embedded=embedded)
    lambdas = artifacts.verify_policy(spark, f"{path}/policy", f"{path}/predictor", log, tiers())
    p = artifacts.load_predictor(spark, f"{path}/predictor", embedded.identity)
    return route(
        log.select("example_id", "prompt"), catalogue(), tiers(), lambdas, p.scorer, p.calibrators, ["example_id"], embedded=embedded
    ).select("example_id", "tier", "decision", micro(F.col("quoted")).alias("quoted_micro"), shown_nano())


def shown_nano():
    """Predicted quality; a hair is added so that means of few rows never sit on a rounding tie."""

    return F.round(F.col("predicted_nano") / 1e9 + 1e-10, 8).alias("predicted")


def catalogue() -> dict[str, Decimal]:
    return {m: Decimal(q) / 1000000 for m, _, q, _ in CATALOGUE}


@query("train_stumps_saved", "S9 M11 M12 K5", trained_sql(stump_sql(ROUNDS)))
def train_stumps_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stump predictor saved, loaded and applied to every prompt."""

    log = dense_log(spark, sf_dir)
    path = scratch_path(spark, "trained-stumps")
    train(log, tiers(), benchmark.StumpConfig(rounds=ROUNDS), path)
    lambdas = artifacts.verify_policy(spark, f"{path}/policy", f"{path}/predictor", log, tiers())
    p = artifacts.load_predictor(spark, f"{path}/predictor")
    assert isinstance(p.scorer, StumpScorer)
    return route(log.select("example_id", "prompt"), catalogue(), tiers(), lambdas, p.scorer, p.calibrators, ["example_id"]).select(
        "example_id", "tier", "decision", micro(F.col("quoted")).alias("quoted_micro"), shown_nano()
    )


@query("route_prompts_demo", "K6 B11 B12 B9", f"""WITH {sql_log()}, {DEMO_SQL}
SELECT example_id, tier, model_id AS decision, quoted AS quoted_micro, round(nano / 1e9, 6) AS predicted FROM demo_q CROSS JOIN tiers WHERE quoted <= budget
QUALIFY row_number() OVER (PARTITION BY example_id, tier ORDER BY
  (CASE tier WHEN 'fast' THEN 5 WHEN 'balanced' THEN 20 ELSE 25 END)::HUGEINT * 1000 * nano - (CASE tier WHEN 'fast' THEN 4 WHEN 'balanced' THEN 7 ELSE 2 END)::HUGEINT * quoted * 1000000 DESC, quoted, model_id) = 1""")
def route_prompts_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document routed by the demonstration rule."""

    r = route(dense_log(spark, sf_dir).select("example_id", "prompt"), catalogue(), tiers(), keep=["example_id"])
    return r.select("example_id", "tier", "decision", micro(F.col("quoted")).alias("quoted_micro"), F.round(F.col("predicted_nano") / 1e9, 6).alias("predicted"))


def stepped_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide log whose charges take five levels, so a calibration maximum covers them all."""

    w = wide_log(spark, sf_dir)
    level = lambda m: F.pmod(F.hash("sample_id", F.lit(m)), F.lit(5))
    return w.withColumns({f"{m}|total_cost": (F.lit(q) * (900 + 50 * level(m)) / 1000 / 1000000) for m, _, q, _ in CATALOGUE})


@query("balanced_diagnostic", "K8 W5 A9 A10 P7 P8 S4 S5")
def balanced_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested benchmark on half of every domain of the wide log, quotes from the other half; documents may be blank."""

    d = diagnostic.balanced_diagnostic(
        stepped_wide(spark, sf_dir), "rev1", {"bilinear": benchmark.LinearConfig()}, calibrate=1, evaluate=1, blank_prompts=True
    )
    return shown_card(d.benchmark.card)


_WIDE_NAMED = f"named AS (SELECT *, {EVAL_CASE.replace('doc_id', 'ord').replace('source', 'tag').replace('lang', 'domain')} AS eval_name FROM long)"


@query("prefix_smoke_replay", "K9 W7 A8 B1 R1", f"""WITH {sql_log()}, {_WIDE_NAMED},
inside AS (SELECT *, dense_rank() OVER (ORDER BY ord) AS rn FROM named WHERE eval_name NOT LIKE 'other-%'),
cal AS (SELECT greatest(1, max(rn) // 5) AS k FROM inside),
quote AS (SELECT model_id, avg(realized) AS quoted FROM inside, cal WHERE rn <= k GROUP BY model_id),
cheap AS (SELECT arg_min(model_id, quoted) AS model_id FROM quote)
SELECT 'always-cheapest' AS policy, 'fast' AS tier, count(*) AS n_queries, 0 AS n_failed, round(sum(q) / 1000.0 / count(*), 6) AS mean_quality, CAST(sum(realized) AS BIGINT) AS spent_micro
FROM inside JOIN cheap USING (model_id), cal WHERE rn > k""")
def prefix_smoke_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest model on all but the first fifth of the wide log; documents may be blank."""

    s = rounded(diagnostic.prefix_replay(wide_log(spark, sf_dir), blank_prompts=True))
    return s.select("policy", "tier", "n_queries", F.col("n_failed").cast("int").alias("n_failed"), "mean_quality", micro(F.col("spent")).alias("spent_micro"))


@query("stream_showcase", "K10 W3 L10 B10", benchmark_sql() + """, st AS (SELECT CAST(ord AS BIGINT) AS step, CAST(ord AS VARCHAR) AS example_id, ['fast', 'balanced', 'premium'][ord % 3 + 1] AS tier FROM (SELECT doc_id AS ord FROM documents)),
pair AS (SELECT step, st.example_id, st.tier, max(model_id) FILTER (policy = 'bilinear') AS selected_model_id, max(model_id) FILTER (policy = 'oracle') AS oracle_model_id,
  max(realized) FILTER (policy = 'bilinear') AS r, max(c.q) FILTER (policy = 'bilinear') AS q, max(c.q) FILTER (policy = 'oracle') AS o
  FROM st JOIN calls c ON c.example_id = st.example_id AND c.tier = st.tier WHERE policy IN ('bilinear', 'oracle') GROUP BY step, st.example_id, st.tier)
SELECT step, example_id, tier, selected_model_id, oracle_model_id, CAST(sum(r) OVER w AS BIGINT) AS cost_micro, round(sum(q) OVER w / sum(o) OVER w, 9) AS retention FROM pair WINDOW w AS (ORDER BY step)""")
def stream_showcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one step on one tier: learned call, oracle call, running retention."""

    b = run_benchmark(spark, sf_dir, "bilinear")
    names = F.array(*[F.lit(t) for t in DENSE_BUDGETS])
    steps = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("step"), F.col("doc_id").cast("string").alias("example_id"), F.get(names, (F.col("doc_id") % 3).cast("int")).alias("tier")
    )
    s = showcase.stream_steps(b, steps)
    return s.select(
        "step", "example_id", "tier", "selected_model_id", "oracle_model_id",
        micro(F.col("running_cost")).alias("cost_micro"), F.round("retention", 9).alias("retention"),
    )


@query("targets_by_model", "M1", f"WITH {sql_log()} SELECT example_id, string_agg(CAST(q AS VARCHAR), ',' ORDER BY model_id) AS q_milli FROM long GROUP BY example_id")
def targets_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = label_view(dense_log(spark, sf_dir))
    return t.select("example_id", F.concat_ws(",", F.transform("targets", lambda v: (v * 1000).cast("bigint").cast("string"))).alias("q_milli"))


@query("embedded_benchmark", "S7 F8 F9 M2 M5 M6 K2", of_vector_documents(benchmark_sql("bilinear", "") + ", " + SQL_GAP + CARD_SQL))
def embedded_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned benchmark on the documents that have a vector, surface plus embedding features."""

    from tollway.catalog.logs import embedded_log
    log, recorded = embedded_log(spark, sf_dir, [policies.seeded_random(), policies.length_heuristic("", "")])
    joined = vectors.attach(log, recorded, 64)
    return shown_card(benchmark.run(joined, tiers(), {"bilinear": benchmark.LinearConfig()}, embedding="embedding", embedding_width=64).card)
