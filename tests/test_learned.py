"""The learned benchmark against a row-by-row reckoning, and its leakage and order rules."""

from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rowwise import Nested, pooled, ridge_fit, stump_fit
from samples import TIERS, sample_log, sample_rows
from tollway.catalog.sample import dense_log, tiers
from tollway.operators import checks, metrics, predict
from tollway.plans import benchmark
from tollway.plans.evaluate import evaluate


def decisions(results, policy):
    return {
        (r["example_id"], r["tier"]): r["decision"]
        for r in results.where(F.col("policy") == policy).select("example_id", "tier", "decision").collect()
    }


def small_rows(spark, sf_dir, per_domain=14):
    """A fixture of a few documents per language, as plain rows."""

    order = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("domain").orderBy("ord"))
    log = dense_log(spark, sf_dir).withColumn("rn", order).where(F.col("rn") <= per_domain).drop("rn").orderBy("ord")
    return [(r["example_id"], r["ord"], r["prompt"], r["domain"], r["observable_tag"], [tuple(m) for m in r["models"]]) for r in log.collect()]


def test_sample_baselines(spark):
    card = {r["policy"]: r for r in evaluate(sample_log(spark), TIERS).card.collect()}
    cheap, best, top = card["always-cheapest"], card["oracle"], card["always-premium"]
    assert [round(cheap[f"{t}_quality"], 9) for t in ("fast", "balanced", "premium")] == [0.60375] * 3
    assert [round(best[f"{t}_quality"], 9) for t in ("fast", "balanced", "premium")] == [0.60375, 0.81375, 0.92625]
    assert top["fast_quality"] is None and top["balanced_quality"] is None and top["weighted_quality"] is None
    assert round(top["premium_quality"], 9) == 0.92625
    assert cheap["gap_recovery"] == 0 and abs(best["gap_recovery"] - 1) < 1e-12 and top["gap_recovery"] is None
    # Every tag is a held-out domain's own, so the table never has an entry.
    assert card["domain-best-table"]["weighted_quality"] == cheap["weighted_quality"]


def test_sample_benchmark_equals_rows(spark):
    b = benchmark.run(sample_log(spark), TIERS, {"bilinear": benchmark.LinearConfig()})
    prices, want = Nested(sample_rows(), ridge_fit).run(TIERS)
    assert decisions(b.results, "bilinear") == want
    for key, price in prices.items():
        num, den = b.tuned["bilinear"].by_key[key]
        assert abs(float(Fraction(num, den) - price)) < 1e-7, key


@pytest.mark.parametrize("family", ["bilinear", "stumps"])
def test_documents_benchmark_equals_rows(spark, sf_dir, family):
    rows = small_rows(spark, sf_dir)
    config = benchmark.LinearConfig() if family == "bilinear" else benchmark.StumpConfig(rounds=3)
    fit = ridge_fit if family == "bilinear" else stump_fit(3)
    b = benchmark.run(sample_log(spark, rows), tiers(), {family: config})
    prices, want = Nested(rows, fit, pooled).run(tiers(), midpoints=False)
    got = decisions(b.results, family)
    assert len(got) == len(want)
    for key, price in prices.items():
        num, den = b.tuned[family].by_key[key]
        assert abs(float(Fraction(num, den) - price)) < 1e-6, key
    assert [k for k in want if got[k] != want[k]] == []


def test_held_out_outcomes_do_not_matter(spark, sf_dir):
    rows = small_rows(spark, sf_dir)
    changed = [
        (*r[:5], [(m, q, c, Decimal(7 - i) / 10) for i, (m, q, c, _) in enumerate(r[5])]) if r[3] == "fr" else r for r in rows
    ]
    configs = {"bilinear": benchmark.LinearConfig()}
    first = benchmark.run(sample_log(spark, rows), tiers(), configs)
    second = benchmark.run(sample_log(spark, changed), tiers(), configs)
    french = {r[0] for r in rows if r[3] == "fr"}
    for policy in ("bilinear", "domain-best-table"):
        a, b = decisions(first.results, policy), decisions(second.results, policy)
        assert {k: v for k, v in a.items() if k[0] in french} == {k: v for k, v in b.items() if k[0] in french}
    for t in tiers():
        assert first.tuned["bilinear"].by_key[("fr", t.tier)] == second.tuned["bilinear"].by_key[("fr", t.tier)]


def test_row_order_and_partitions_do_not_matter(spark, sf_dir):
    rows = small_rows(spark, sf_dir)
    configs = {"bilinear": benchmark.LinearConfig()}
    seen = []
    for parts in (1, 17):
        b = benchmark.run(sample_log(spark, rows[::-1]).repartition(parts), tiers(), configs)
        seen.append((decisions(b.results, "bilinear"), b.tuned["bilinear"].by_key))
    assert seen[0][0] == seen[1][0]
    for key, (num, den) in seen[0][1].items():
        assert abs(num / den - seen[1][1][key][0] / seen[1][1][key][1]) < 1e-7


def test_cross_fitted_table_covers_the_log(spark, sf_dir):
    log = sample_log(spark, small_rows(spark, sf_dir))
    p = benchmark.prepare_fits(log, tiers())
    f = benchmark.fit(p, benchmark.LinearConfig(), [*p.plan.masks(1), *p.plan.masks(2)], p.plan.masks(1))
    pairs = predict.long_predictions(benchmark.held_out_predictions(p.features, p, f))
    want = log.select("example_id", F.explode("models").alias("m")).select("example_id", "m.model_id")
    assert checks.coverage(want, pairs, ["example_id", "model_id"]).isEmpty()
    lost = pairs.where("example_id <> '0'")
    assert checks.coverage(want, lost, ["example_id", "model_id"]).where("problem = 'missing'").count() == 5


def test_capped_search_stays_feasible(spark, sf_dir):
    rows = small_rows(spark, sf_dir)
    b = benchmark.run(sample_log(spark, rows), tiers(), {"bilinear": benchmark.LinearConfig()}, cap=8)
    full = benchmark.run(sample_log(spark, rows), tiers(), {"bilinear": benchmark.LinearConfig()})
    best = {(r["outer"], r["tier"]): r["quality_sum"] for r in full.tuned["bilinear"].selection.collect()}
    for r in b.tuned["bilinear"].selection.collect():
        assert r["quality_sum"] <= best[(r["outer"], r["tier"])]


def test_comparison_has_no_winner(spark, sf_dir):
    log = sample_log(spark, small_rows(spark, sf_dir))
    b = benchmark.run(log, tiers(), {"bilinear": benchmark.LinearConfig(), "stumps": benchmark.StumpConfig(rounds=2)})
    overall, held = benchmark.compare(b)
    row = overall.first()
    card = {r["policy"]: r for r in b.card.collect()}
    want = card["stumps"]["weighted_quality"] - card["bilinear"]["weighted_quality"]
    assert abs(row["delta_weighted_quality"] - want) < 1e-12
    assert held.count() == 4 and not any("winner" in c for c in held.columns)
    assert metrics.oracle_violations(b.results).isEmpty()


def test_wide_catalogues_use_the_long_path(spark, sf_dir, monkeypatch):
    from tollway.functions.encode import with_features
    from tollway.operators import cells

    log = with_features(sample_log(spark, small_rows(spark, sf_dir)))
    key = lambda r: (r["domain"], tuple(r["x"]))
    wide = sorted(cells.cells(log, tiers(), 5).collect(), key=key)
    monkeypatch.setattr(cells, "WIDE_MODELS", 2)
    assert sorted(cells.cells(log, tiers(), 5).collect(), key=key) == wide


def test_model_state_can_go_in_passes(spark, sf_dir, monkeypatch):
    from tollway.operators import isotonic, scoring

    p = benchmark.prepare_fits(sample_log(spark, small_rows(spark, sf_dir)), tiers())
    f = benchmark.fit(p, benchmark.LinearConfig(), p.plan.training_masks(), p.plan.calibration_masks())
    key = lambda r: (r["domain"], r["mask"], tuple(r["x"]))
    once = sorted(predict.predict_excluding(p.cells, p.plan, f.scorer, f.calibrators, p.plan.masks(2)).collect(), key=key)
    monkeypatch.setattr(predict, "SHIP_BYTES", 1)
    many = sorted(predict.predict_excluding(p.cells, p.plan, f.scorer, f.calibrators, p.plan.masks(2)).collect(), key=key)
    assert once == many
    groups = scoring.mask_passes(f.scorer, p.plan.training_masks(), limit=1)
    assert [m for g in groups for m in g] == p.plan.training_masks() and len(groups) == 14
    assert isotonic.calibration_pairs(p.cells, f.scorer, p.plan, p.plan.masks(1)).count() > 0
