"""Policies, budgets and reports on small logs."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from samples import MODELS, TIERS, sample_log, sample_rows
from tollway.operators import checks, metrics, policies
from tollway.operators.folds import domain_list, fold_violations, with_folds
from tollway.operators.ledger import cumulative, multi_call, replay, sequential_replay
from tollway.operators.profile import profile
from tollway.schema import LOG_SCHEMA, TierSpec, cost_lit


def one(spark, models, prompt="hi"):
    rows = [("q1", 0, prompt, "d", None, [(m, Decimal(q), Decimal(r), Decimal(str(y))) for m, q, r, y in models])]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def tier(budget, name="fast"):
    return [TierSpec(name, Decimal(budget), 1.0)]


def test_ties_go_to_the_smaller_id(spark):
    log = one(spark, [("a", "1", "1", 0.5), ("b", "1", "1", 0.5)])
    got = {r["policy"]: r["decision"] for r in replay(log, tier("2"), [policies.always_cheapest(), policies.oracle()]).collect()}
    assert got == {"always-cheapest": "a", "oracle": "a"}


def test_refused_and_overspent_queries(spark):
    log = one(spark, [("a", "1", "3", 0.5), ("b", "5", "1", 0.9)])
    rules = [policies.always_cheapest(), policies.always_premium("b"), policies.always_premium("zz")]
    got = [replay(log, tier("2"), [p]).first() for p in rules]
    over, dear, unknown = got
    assert not over["feasible"] and over["cost"] == 3 and over["remaining_after"] == 0 and over["within_budget"] is False
    assert not dear["feasible"] and dear["cost"] == 0 and dear["remaining_after"] == 2 and not dear["call_made"]
    assert unknown["error"] == "unknown model" and unknown["quality"] is None
    assert replay(log, tier("2"), [policies.oracle()]).first()["error"].startswith("nothing")


def test_random_matches_its_definition(spark):
    log = sample_log(spark)
    got = {(r["example_id"], r["tier"]): r["decision"] for r in replay(log, TIERS, [policies.seeded_random(7)]).collect()}
    for example_id, _, prompt, *_ in sample_rows():
        for t in TIERS:
            ids = sorted(m for m, q in MODELS.items() if q <= t.budget)
            u = int.from_bytes(hashlib.sha256(f"7\0{prompt}\0{t.tier}".encode()).digest()[:8], "big")
            assert got[(example_id, t.tier)] == ids[u % len(ids)]


def test_length_threshold_is_inclusive(spark):
    models = [("a", "1", "1", 0.5), ("b", "2", "2", 0.9)]
    rule = policies.length_heuristic("a", "b", 5)
    assert replay(one(spark, models, "12345"), tier("2"), [rule]).first()["decision"] == "b"
    assert replay(one(spark, models, "1234"), tier("2"), [rule]).first()["decision"] == "a"
    assert replay(one(spark, models, "12345"), tier("1"), [rule]).first()["decision"] == "a"


def test_domain_table_falls_back_only_when_that_helps(spark):
    models = [("a", "1", "1", 0.5), ("b", "3", "3", 0.9)]
    table = F.create_map(F.lit("fast"), F.lit("b"))
    none = F.lit(None).cast("map<string,string>")
    pick = lambda t, b: replay(one(spark, models), tier(b), [policies.domain_table(t, "a")]).first()["decision"]
    assert pick(table, "3") == "b" and pick(table, "2") == "a" and pick(table, "0.5") == "b" and pick(none, "3") == "a"


def test_infeasible_tier_nulls_the_weighted_score(spark):
    scores = metrics.tier_scores(replay(sample_log(spark), TIERS, [policies.always_premium("expert")]))
    assert {r["tier"]: r["mean_quality"] for r in scores.collect()}["fast"] is None
    assert metrics.weighted_quality(scores).first()["weighted_quality"] is None


def test_gap_rules(spark):
    def scores(rows):
        return spark.createDataFrame(
            [(p, "fast", 0, 1.0, 2, 0, q, Decimal(0), 0) for p, q in rows],
            "policy string, tier string, tier_pos int, weight double, n_queries bigint, n_failed bigint, mean_quality double, spent decimal(38,12), over_budget_calls bigint",
        )

    gap = lambda rows: {r["policy"]: r["gap_recovery"] for r in metrics.gap_recovery(scores(rows)).collect()}
    assert gap([("always-cheapest", 0.2), ("oracle", 0.8), ("x", 0.5)])["x"] == pytest.approx(0.5)
    assert gap([("always-cheapest", 0.4), ("oracle", 0.8), ("x", 0.2)])["x"] == pytest.approx(-0.5)
    assert gap([("always-cheapest", 0.4), ("oracle", 0.4), ("x", 0.4)])["x"] is None
    assert gap([("always-cheapest", 0.4), ("oracle", 0.8), ("x", None)])["x"] is None
    with pytest.raises(Exception, match="exceeds"):
        gap([("always-cheapest", 0.4), ("oracle", 0.8), ("x", 0.9)])
    with pytest.raises(Exception, match="below cheapest"):
        gap([("always-cheapest", 0.9), ("oracle", 0.8)])
    uneven = scores([("always-cheapest", 0.2), ("oracle", 0.8), ("x", 0.5)]).withColumn(
        "n_queries", F.when(F.col("policy") == "x", 3).otherwise(F.col("n_queries")).cast("bigint")
    )
    with pytest.raises(Exception, match="scopes"):
        metrics.gap_recovery(uneven).collect()


def test_cumulative_hand_case(spark):
    calls = spark.createDataFrame([("k", 0, Decimal("0.75")), ("k", 1, Decimal("0.5")), ("k", 2, Decimal(0))], "k string, i bigint, c decimal(28,12)")
    r = cumulative(calls, ["k"], "i", "c", cost_lit(1)).orderBy("i").collect()
    assert [x["over"] for x in r] == [False, True, False]
    assert [x["remaining_after"] for x in r] == [Decimal("0.25"), 0, 0] and r[1]["spent"] == Decimal("1.25")


def simulate(rows, budget, choose):
    """The shared-budget recurrence, one row after the other."""

    left, out = budget, {}
    for example_id, _, prompt, _, _, models in rows:
        pick = choose(models, prompt, left)
        hit = next((m for m in models if m[0] == pick), None)
        if hit is None or hit[1] > left:
            out[example_id] = (pick, Decimal(0), False)
        else:
            out[example_id] = (pick, hit[2], hit[2] <= left)
            left = max(left - hit[2], Decimal(0))
    return out


@pytest.mark.parametrize("stable", [True, False])
def test_sequential_replay_equals_the_recurrence(spark, stable):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(160):
        models = []
        for m, base in (("a", 100), ("b", 250), ("c", 600)):
            quote = base if stable else base + rng.randint(-40, 40)
            models.append((m, Decimal(quote) / 1000, Decimal(rng.randint(50, 700)) / 1000, Decimal(rng.randint(0, 999)) / 1000))
        rows.append((f"e{i}", i, f"prompt {i}", "d", None, models))
    log = spark.createDataFrame(rows, LOG_SCHEMA)
    budget = Decimal(20)
    rules = [policies.always_cheapest(), policies.always_premium("c"), policies.seeded_random(3)]

    def random_pick(models, prompt, left):
        ids = sorted(m[0] for m in models if m[1] <= left)
        if not ids:
            return min(models, key=lambda m: (m[1], m[0]))[0]
        u = int.from_bytes(hashlib.sha256(f"3\0{prompt}\0fast".encode()).digest()[:8], "big")
        return ids[u % len(ids)]

    want = {
        "always-cheapest": simulate(rows, budget, lambda m, p, left: min(m, key=lambda x: (x[1], x[0]))[0]),
        "always-premium": simulate(rows, budget, lambda m, p, left: "c"),
        "random": simulate(rows, budget, random_pick),
    }
    got = sequential_replay(log, [TierSpec("fast", budget, 1.0)], rules).collect()
    assert len(got) == 480
    for r in got:
        pick, cost, ok = want[r["policy"]][r["example_id"]]
        assert (r["decision"], r["cost"], r["feasible"]) == (pick, cost, ok), r


def test_ledger_rows_are_not_sorted_for_joins(spark):
    # balances, range totals and decisions meet the rows without a second shuffle, whatever Spark thinks of their sizes
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        budget = [TierSpec(t.tier, t.budget * 4, t.weight) for t in TIERS]
        got = sequential_replay(sample_log(spark), budget, [policies.always_cheapest(), policies.always_premium("expert")], ["domain"])
        calls = spark.createDataFrame([(k % 3, k, Decimal(k)) for k in range(40)], "k int, ord bigint, c decimal(28,12)")
        spent = cumulative(calls, ["k"], "ord", "c", cost_lit(9), bounds=[10.0, 20.0])
        for df in (got, spent):
            assert "SortMergeJoin" not in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
        assert got.count() == 48 and spent.agg(F.max("spent")).first()[0] == 273
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_multi_call(spark):
    schema = "policy string, tier string, example_id string, call_idx int, model_id string, quoted decimal(28,12), realized decimal(28,12), quality decimal(20,12), budget decimal(28,12), selected boolean"
    D = Decimal
    rows = [
        ("p", "fast", "ok", 0, "a", D("0.2"), D("0.2"), D("0.5"), D(1), False), ("p", "fast", "ok", 1, "b", D("0.6"), D("0.6"), D("0.8"), D(1), True),
        ("p", "fast", "over", 0, "a", D("0.2"), D("0.5"), D("0.5"), D(1), False), ("p", "fast", "over", 1, "b", D("0.5"), D("0.7"), D("0.8"), D(1), True),
        ("p", "fast", "refused", 0, "a", D("0.2"), D("0.9"), D("0.5"), D(1), True), ("p", "fast", "refused", 1, "b", D("0.5"), D("0.1"), D("0.8"), D(1), False),
    ]
    calls = spark.createDataFrame(rows, schema)
    r = {x["example_id"]: x for x in multi_call(calls, max_calls=2).collect()}
    assert r["ok"]["feasible"] and r["ok"]["selected_model_id"] == "b" and r["ok"]["cost"] == D("0.8")
    assert not r["over"]["feasible"] and r["over"]["cost"] == D("1.2") and r["over"]["n_calls"] == 2
    assert not r["refused"]["feasible"] and r["refused"]["cost"] == D("0.9") and r["refused"]["n_calls"] == 1
    short = {x["example_id"]: x for x in multi_call(calls, max_calls=1).collect()}
    assert not short["ok"]["feasible"] and short["ok"]["n_calls"] == 1


def test_fold_checks(spark):
    log = sample_log(spark)
    folds = with_folds(log, domain_list(log))
    assert fold_violations(folds).isEmpty()
    leaked = folds.unionByName(folds.where("role = 'test'").limit(1).withColumn("role", F.lit("train")))
    assert not fold_violations(leaked).isEmpty()
    assert fold_violations(folds.where("not (held_out = 'code' and role = 'test')")).count() >= 2


def test_unstable_catalogue_is_an_error(spark):
    rows = sample_rows()
    rows[3][5][0] = ("expert", Decimal("0.99"), Decimal(1), Decimal("0.9"))
    with pytest.raises(ValueError, match="same in every example"):
        checks.catalogue(sample_log(spark, rows))
    with pytest.raises(ValueError, match="same in every example"):
        profile(sample_log(spark, rows)).roles()
    rows[3][5].pop()
    with pytest.raises(ValueError, match="same models"):
        profile(sample_log(spark, rows))


def test_profile(spark):
    p = profile(sample_log(spark))
    assert p.domains == ["code", "general", "math", "science"] and p.counts["math"] == 2
    assert p.model_ids == sorted(MODELS) and p.quotes == MODELS and p.roles() == ("swift", "expert")


def test_custom_policy_reads_the_view(spark):
    long_prompt = policies.Policy(
        "by-length", lambda v: F.when(F.length(v.prompt) > 40, F.lit("steady")).otherwise(policies.cheapest_of(v.candidates)), reads_prompt=True
    )
    one_shot = {(r["example_id"], r["tier"]): r["decision"] for r in replay(sample_log(spark), TIERS, [long_prompt]).collect()}
    shared = sequential_replay(sample_log(spark), [TierSpec(t.tier, t.budget * 100, t.weight) for t in TIERS], [long_prompt])
    assert one_shot == {(r["example_id"], r["tier"]): r["decision"] for r in shared.collect()}
    assert set(one_shot.values()) == {"swift", "steady"}


def test_running_retention(spark):
    steps = spark.createDataFrame(
        [("s", 1, Decimal("0.2"), Decimal("0.78"), Decimal("0.78")), ("s", 2, Decimal("0.6"), Decimal("0.75"), Decimal("0.75")), ("s", 3, Decimal(1), Decimal("0.96"), Decimal("0.96")), ("z", 1, Decimal(0), Decimal(0), Decimal(0))],
        "k string, i bigint, realized decimal(28,12), quality decimal(20,12), oracle_quality decimal(20,12)",
    )
    r = metrics.running_retention(steps, ["k"], "i").orderBy("k", "i").collect()
    assert [x["running_cost"] for x in r[:3]] == [Decimal("0.2"), Decimal("0.8"), Decimal("1.8")]
    assert [x["retention"] for x in r] == [1.0, 1.0, 1.0, None]
