"""Hand-computed cases of the numeric parts."""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollway.operators import isotonic, lambdas, moments, policies, prefix, ridge, stumps
from tollway.operators.folds import SubsetPlan
from tollway.operators.moments import Moments
from tollway.operators.prefix import next_step, running_totals
from tollway.operators.scoring import Calibrators, StumpScorer


def of(x, y):
    x, y = np.array(x, float), np.array(y, float)
    return Moments(len(x), x.sum(0), y.sum(0), x.T @ x, x.T @ y)


def test_ridge_hand_case():
    m = of([[0, 0], [1, 0], [0, 1], [1, 1]], [[5, -2], [7, -3], [2, 2], [4, 1]])
    w, b = ridge.solve(m, 1.0, scaled=0, surface=False)
    assert np.allclose(w, [[1, -1.5], [-0.5, 2]])
    assert np.allclose(b, [4.75, -1.25])


def test_moments_merge_like_one_pass():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 5)), rng.normal(size=(40, 2))
    parts = [of(x[i::3], y[i::3]) for i in range(3)]
    total, whole = parts[0] + parts[1] + parts[2], of(x, y)
    for a, b in zip(total.centered, whole.centered):
        assert np.allclose(a, b, atol=1e-9)


def test_moments_keep_the_spread_of_a_feature_with_a_large_mean(spark):
    rng = np.random.default_rng(8)
    x = np.stack([1e6 + rng.normal(scale=1e-3, size=3000), rng.normal(size=3000)], axis=1)
    y = np.round(0.5 + rng.uniform(-0.5, 0.5, size=(3000, 1)), 6)
    domains = ["hot" if i % 3 else "cold" for i in range(3000)]
    cells = cells_of(spark, domains, x, y).repartition(5)
    total = moments.combine(moments.load(moments.domain_moments(cells, 2, 1), 2, 1), [])
    xc, yc = x - x.mean(0), y - y.mean(0)
    for got, want in zip(total.centered, (xc.T @ xc, xc.T @ yc)):
        assert np.allclose(got, want, rtol=1e-6, atol=1e-6 * np.abs(want).max())
    assert abs(total.centered[0][0, 0] / (xc[:, 0] @ xc[:, 0]) - 1) < 1e-6
    assert np.allclose(total.mean_x, x.mean(0), rtol=1e-12) and total.n == 3000


def test_packed_moments_round_trip():
    m = of(np.arange(12).reshape(4, 3), np.arange(8).reshape(4, 2))
    back = moments.unpack(moments._pack(m), 3, 2)
    assert np.allclose(back.sxx, m.sxx) and np.allclose(back.sxy, m.sxy) and back.n == 4


def test_pooling_hand_case():
    ub, y, n = isotonic.pool(np.array([0.1, 0.2, 0.3]), np.array([0.2, 0.8, 0.4]), np.ones(3))
    assert np.allclose(ub, [0.1, 0.3]) and np.allclose(y / n, [0.2, 0.6])
    c = Calibrators({(0, 0): (ub, y / n)})
    assert np.allclose(c.apply(np.array([[0.25], [0.05], [0.1], [9.0]]), 0).ravel(), [0.6, 0.2, 0.2, 0.6])


def test_range_wise_pooling_equals_one_pass(spark):
    rng = np.random.default_rng(11)
    score = np.round(rng.uniform(size=600), 2)
    y = score + rng.normal(scale=0.4, size=600)
    rows = [(0, 0, float(s), float(t), 1.0) for s, t in zip(score, y)]
    pairs = spark.createDataFrame(rows, isotonic.BLOCKS)
    got = isotonic.load(isotonic.fit(pairs, group_blocks=5)).steps[(0, 0)]
    points = np.unique(score)
    sums = np.array([y[score == p].sum() for p in points])
    counts = np.array([(score == p).sum() for p in points], float)
    ub, s, n = isotonic.pool(points, sums, counts)
    assert np.allclose(got[0], ub) and np.allclose(got[1], s / n)


@pytest.mark.parametrize("shape", ["rising", "falling", "late drop", "saw"])
def test_pooling_in_groups_keeps_blocks_apart(spark, shape):
    i = np.arange(400)
    y = {
        "rising": i / 400, "falling": 1 - i / 400, "late drop": np.where(i < 390, i / 400, 0.0), "saw": (i % 7) / 7 + i / 800,
    }[shape]
    rows = [(0, k, float(s), float(v), 1.0) for k in range(2) for s, v in zip(i, y)]
    steps = isotonic.fit(spark.createDataFrame(rows, isotonic.BLOCKS), group_blocks=32)
    got = isotonic.load(steps).steps
    ub, s, n = isotonic.pool(i.astype(float), y, np.ones(400))
    for k in range(2):
        assert np.allclose(got[(0, k)][0], ub) and np.allclose(got[(0, k)][1], s / n)


def test_a_common_value_spreads_over_ranges(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(77).alias("o"), "id", F.lit("k").alias("k"))
    sizes = [r["count"] for r in prefix.deal(df, "o", ["id"]).groupBy(prefix.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20000 / 8
    out = running_totals(df, ["k"], "o", {"t": F.lit(1)}, tie_break=["id"]).orderBy("t").collect()
    assert [r["t"] for r in out] == list(range(1, 20001))
    assert [(r["o"], r["id"]) for r in out] == sorted((r["o"], r["id"]) for r in out)


def test_common_points_and_nulls_find_their_steps(spark):
    points = [(0, i, 0.5 if i % 10 else i / 1000) for i in range(500)] + [(0, 500, None), (None, 501, 0.3)]
    steps = [(0, 0.2, 1.0), (0, 0.5, 2.0), (0, 0.9, 3.0)]
    got = next_step(
        spark.createDataFrame(points, "k int, i int, s double"), spark.createDataFrame(steps, "k int, ub double, value double"),
        ["k"], "s", "ub", "value",
    )
    value = {r["i"]: r["value"] for r in got.collect()}
    assert len(value) == 502 and value[500] is None and value[501] is None
    assert all(value[i] == (1.0 if s <= 0.2 else 2.0) for _, i, s in points[:500])


def test_nearest_step_join_equals_local_lookup(spark):
    rng = np.random.default_rng(5)
    ub = np.sort(rng.choice(np.arange(0, 1000) / 1000, 60, replace=False))
    steps = [(k, float(u), float(i)) for k in range(3) for i, u in enumerate(ub)]
    points = [(int(k), int(i), float(s)) for i, (k, s) in enumerate(zip(rng.integers(0, 3, 800), rng.integers(-50, 1100, 800) / 1000))]
    p = spark.createDataFrame(points, "k int, i int, s double")
    t = spark.createDataFrame(steps, "k int, ub double, value double")
    got = {r["i"]: r["value"] for r in next_step(p, t, ["k"], "s", "ub", "value").collect()}
    assert len(got) == 800
    for _, i, s in points:
        assert got[i] == min(np.searchsorted(ub, s, side="left"), 59)


def test_steps_are_found_in_small_groups(spark):
    rng = np.random.default_rng(8)
    ub = np.sort(rng.choice(np.arange(0, 3000) / 1000, 900, replace=False))
    steps = [("a", float(u), float(i)) for i, u in enumerate(ub)] + [("b", 1.5, 7.0)]
    # A third of all points are one value, equal to a bound; one key has no steps.
    points = [("a", i, float(ub[450]) if i % 3 == 0 else float(s)) for i, s in enumerate(rng.integers(-100, 3200, 2400) / 1000)]
    points += [("b", 2400, 9.0), ("b", 2401, 0.0), ("c", 2402, 1.0)]
    p = spark.createDataFrame(points, "k string, i int, s double")
    t = spark.createDataFrame(steps, "k string, ub double, value double")
    for group in (40, 100_000):
        got = {r["i"]: r["value"] for r in next_step(p, t, ["k"], "s", "ub", "value", group).collect()}
        assert len(got) == 2403 and (got[2400], got[2401], got[2402]) == (7.0, 7.0, None)
        assert all(got[i] == min(np.searchsorted(ub, s, side="left"), 899) for k, i, s in points if k == "a")
    none = next_step(p, t.limit(0), ["k"], "s", "ub", "value")
    assert none.count() == 2403 and none.where("value is not null").isEmpty()
    assert next_step(p.limit(0), t, ["k"], "s", "ub", "value").isEmpty()


def test_falls_are_found_within_and_across_ranges(spark):
    rows = [(k, i / 100, float(i // 5)) for k in range(2) for i in range(400)]
    schema = "k int, ub double, value double"
    assert prefix.falls(spark.createDataFrame(rows, schema), ["k"], "ub", "value").isEmpty()
    for at in (1, 57, 200, 399):
        bad = rows[:at] + [(0, at / 100, -1.0)] + rows[at + 1:]
        found = prefix.falls(spark.createDataFrame(bad, schema), ["k"], "ub", "value").collect()
        assert [(r["k"], r["ub"]) for r in found] == [(0, at / 100)]
    twice = prefix.falls(spark.createDataFrame([*rows, (1, 2.0, 500.0)], schema), ["k"], "ub", "value").collect()
    assert {r["k"] for r in twice} == {1}


def test_running_totals_with_a_hot_key(spark):
    rows = [("hot", i, Decimal(i % 7)) for i in range(3000)] + [(f"k{i % 50}", i, Decimal(1)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint, v decimal(28,12)").repartition(5)
    out = running_totals(df, ["k"], "i", {"t": F.col("v")}).collect()
    want, sums = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[(k, i)] = sums[k]
    assert len(out) == len(rows)
    assert all(r["t"] == want[(r["k"], r["i"])] for r in out)
    assert running_totals(df, ["k"], "i", {"t": F.col("v")}, bounds=[]).where("t is null").isEmpty()


def cells_of(spark, domains, x, y):
    rows = [(d, int(1), [float(v) for v in xr], [Decimal(str(v)) for v in yr]) for d, xr, yr in zip(domains, x, y)]
    return spark.createDataFrame(rows, "domain string, n bigint, x array<double>, sum_q array<decimal(38,12)>")


def slim_cells(spark, domains, x, y):
    return cells_of(spark, domains, x, y).select("domain", "n", "x", F.col("sum_q").cast("array<double>").alias("y"))


def test_stumps_hand_case(spark):
    x, y = [[0.0], [1.0], [2.0], [3.0]], [[0], [0], [2], [2]]
    plan = SubsetPlan(("a", "b"))
    cells = cells_of(spark, ["a"] * 4, x, y)
    scorer = stumps.fit(cells, {"a": of(x, y)}, plan, [0], rounds=2, rate=0.5, min_leaf=1)
    assert scorer.base[0][0] == 1.0
    assert scorer.stumps[0][0] == [(0, 2.0, -1.0, 1.0), (0, 2.0, -0.5, 0.5)]
    assert np.allclose(scorer.score(np.array(x), 0).ravel(), [0.25, 0.25, 1.75, 1.75])


def test_stump_splits_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = np.round(0.5 + 0.1 * x[:, :1] + rng.uniform(-0.2, 0.2, (300, 2)), 3)
    domains = [("a", "b", "c", "d")[i % 4] for i in range(300)]
    plan, masks = SubsetPlan(("a", "b", "c", "d")), [0, 1, 6]
    scorer = StumpScorer(0.1, {m: np.full(2, 0.5) for m in masks}, {m: [[], []] for m in masks})
    cells = slim_cells(spark, domains, x, y).repartition(4)
    whole, cut = [
        {(r["mask"], r["model_pos"]): r for r in stumps.best_splits(stumps.residual_sums(cells, scorer, plan, masks, bounds), masks, 2, 2).collect()}
        for bounds in ([], [-0.9, 0.0, 0.7])
    ]
    assert len(whole) == 6
    for (mask, k), r in whole.items():
        at = [i for i, d in enumerate(domains) if not plan.bit(d) & mask]
        q = y[at, k] - 0.5
        gains = {}
        for f in range(3):
            for v in np.unique(x[at, f]):
                side = x[at, f] < v
                if min(side.sum(), (~side).sum()) >= 2:
                    gains[f, v] = q[side].sum() ** 2 / side.sum() + q[~side].sum() ** 2 / (~side).sum() - q.sum() ** 2 / len(q)
        f, v = min(gains, key=lambda g: (-round(gains[g], 10), g))
        for got in (r, cut[mask, k]):
            assert (got["feature"], got["value"]) == (f, v) and np.isclose(got["gain"], gains[f, v])


def exact_chain(x, y, rounds):
    """One model's stumps row by row in whole fractions: best gain to GAIN_DIGITS digits, then feature, then value."""

    y = [Fraction(str(v)) for v in y]
    r, chain = [v - sum(y) / len(y) for v in y], []
    for _ in range(rounds):
        best, total = None, sum(r)
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[1:]:
                side = [q for q, w in zip(r, x[:, f]) if w < v]
                nl, nr, left = len(side), len(r) - len(side), sum(side)
                if min(nl, nr) >= 2:
                    gain = left**2 / nl + (total - left) ** 2 / nr - total**2 / len(r)
                    key = (-round(gain, stumps.GAIN_DIGITS), f, v)
                    if best is None or key < best[0]:
                        best = (key, left / nl, (total - left) / nr)
        (gain, f, v), left, right = best
        if -gain <= 10**-stumps.GAIN_DIGITS:
            break
        chain.append((f, float(v), float(left), float(right)))
        r = [q - (left if w < v else right) / 10 for q, w in zip(r, x[:, f])]
    return chain


def test_all_rounds_equal_exact_rows(spark):
    rng = np.random.default_rng(11)
    a = np.round(rng.normal(size=36), 1)
    # every split of the first feature is one of the second, too, and one of the third from the other side
    x = np.stack([a, np.exp(a), -a, np.round(rng.normal(size=36), 1)], axis=1)
    y = np.round(rng.uniform(0, 1, (36, 2)), 3)
    domains = [("a", "b", "c")[i % 3] for i in range(36)]
    by_domain = {d: of(x[[e == d for e in domains]], y[[e == d for e in domains]]) for d in "abc"}
    plan = SubsetPlan(("a", "b", "c"))
    scorer = stumps.fit(cells_of(spark, domains, x, y).repartition(5), by_domain, plan, [0, 2])
    for mask in (0, 2):
        at = [i for i, d in enumerate(domains) if not plan.bit(d) & mask]
        for k in range(2):
            want, got = exact_chain(x[at], y[at, k], 32), scorer.stumps[mask][k]
            assert len(got) == 32 and [g[0] for g in got] == [w[0] for w in want]
            assert np.allclose([g[1:] for g in got], [w[1:] for w in want], atol=1e-11)


def test_residual_sums_are_exact_in_any_order(spark):
    rng = np.random.default_rng(12)
    a = np.round(rng.normal(size=400), 1)
    x, y = np.stack([a, np.exp(a), -a], axis=1), np.round(rng.uniform(0, 1, (400, 1)), 3)
    scorer = StumpScorer(0.1, {0: np.array([1 / 3])}, {0: [[(0, 0.1, -1 / 7, 1 / 9)]]})
    cells = slim_cells(spark, ["a"] * 400, x, y)
    runs = []
    for parts in (1, 7):
        rows = stumps.residual_sums(cells.repartition(parts), scorer, SubsetPlan(("a", "b")), [0], []).collect()
        added = [{}, {}, {}]
        for r in rows:
            if r["kind"] == stumps.VALUE:
                at = added[r["feature"]]
                at[r["value"]] = [p + q for p, q in zip(at.get(r["value"], [0.0] * 3), r["v"])]
        runs.append([[at[v] for v in sorted(at)] for at in added])
    (first, copy, turned), again = runs
    assert first == copy == turned[::-1] and runs[0] == again


def test_scores_written_between_rounds_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x, y = np.round(rng.normal(size=(60, 3)), 1), np.round(rng.uniform(0, 1, (60, 2)), 3)
    domains = [("a", "b", "c")[i % 3] for i in range(60)]
    by_domain = {d: of(x[[e == d for e in domains]], y[[e == d for e in domains]]) for d in "abc"}
    cells, plan = cells_of(spark, domains, x, y).repartition(3), SubsetPlan(("a", "b", "c"))
    monkeypatch.setattr(stumps, "CHUNK_BYTES", 500)
    chains = []
    for refresh, size in ((100, stumps.RANGE_BYTES), (1, 900), (3, stumps.RANGE_BYTES)):
        monkeypatch.setattr(stumps, "REFRESH", refresh)
        monkeypatch.setattr(stumps, "RANGE_BYTES", size)
        chains.append(stumps.fit(cells, by_domain, plan, [0, 2, 4], rounds=7).stumps)
    assert chains[0] == chains[1] == chains[2] and all(len(c) == 7 for m in chains[0].values() for c in m)


def test_registered_stumps_run_the_default_rounds():
    from tollway.catalog import learned

    assert learned.ROUNDS == stumps.ROUNDS == 32


def test_stumps_constant_target(spark):
    x, y = [[0.0], [1.0], [2.0]], [[0.5]] * 3
    scorer = stumps.fit(cells_of(spark, ["a"] * 3, x, y), {"a": of(x, y)}, SubsetPlan(("a", "b")), [0], rounds=3, min_leaf=1)
    assert scorer.stumps[0][0] == [] and scorer.base[0][0] == 0.5


def test_subset_counts():
    plan = SubsetPlan(tuple("abcdefg"))
    c = plan.counts(34778)
    assert c["subsets"] == 63 and c["score_blocks"] == 154
    assert c["memberships_per_row"] == 22 and c["calibrated_fits"] == 49
    assert c["row_memberships"] == 765116
    assert len(plan.training_masks()) == 63 and len(plan.calibration_masks()) == 28
    with pytest.raises(ValueError):
        SubsetPlan(("a", "b", "c")).training_masks()


def test_intervals_agree_with_a_dense_grid(spark):
    costs = {"a": 0, "b": 2, "c": 5}
    for q in ((0, 0.5, 1), (0.25, 0.75, 1), (0.5, 0.5, 0.5), (1, 0.2, 0.9)):
        models = [(m, Decimal(c), Decimal(c), Decimal(0)) for m, c in costs.items()]
        row = spark.createDataFrame(
            [(models, [int(v * 10**9) for v in q])],
            "models array<struct<model_id:string,quoted:decimal(28,12),realized:decimal(28,12),quality:decimal(20,12)>>, predicted array<bigint>",
        )
        scored = F.transform(lambdas.scored_models(), lambda m, i: m.withField("pos", i))
        got = row.select(F.explode(lambdas.winner_intervals(scored)).alias("w")).select("w.*").collect()
        for k in range(0, 121):
            price = Fraction(k, 120)
            key = price / 1000  # one unit of lambda is 0.001 key units
            won = [w["pos"] for w in got if Fraction(w["lo"]["key"]) <= key + Fraction(1, 10**20) and (w["hi"] is None or key < Fraction(w["hi"]["key"]) - Fraction(1, 10**20))]
            best = min((-(Fraction(v) - price * c), c, i) for i, (v, c) in enumerate(zip(q, costs.values())))[2]
            assert won == [best], (q, price)


def test_lambda_digits_are_checked():
    with pytest.raises(ValueError):
        policies.check_lambda(-1, 2)
    with pytest.raises(ValueError):
        policies.check_lambda(1, 10**13)
