"""The exact shared-budget search against a plain replay at every root."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest

from samples import TIERS, sample_log
from tollway.operators import tuning
from tollway.plans import benchmark
from tollway.plans.train import train
from tollway.schema import LOG_SCHEMA, TierSpec

CENT = Decimal("0.01")


def made_log(spark, ledgers):
    """``ledgers``: name -> rows of (model, quoted, realized, quality, predicted) in hundredths."""

    rows = []
    for name, prompts in ledgers.items():
        for i, models in enumerate(prompts):
            shown = [(m, q * CENT, r * CENT, y * CENT) for m, q, r, y, _ in models]
            rows.append((f"{name}-{i}", i, "text", name, name, shown, [p * 10_000_000 for *_, p in models]))
    schema = LOG_SCHEMA.simpleString()[len("struct<"):-1]
    return spark.createDataFrame(rows, f"struct<{schema},predicted:array<bigint>>").withColumnRenamed("observable_tag", "tag")


def plain_best(prompts, budget):
    """(quality, spend, lambda) of the best feasible replay, in hundredths; None without one."""

    roots = {Fraction(0)}
    for models in prompts:
        fits = [m for m in models if m[1] <= budget]
        roots |= {Fraction(a[4] - b[4], a[1] - b[1]) for a in fits for b in fits if a[1] > b[1] and a[4] >= b[4]}
    best = None
    for lam in roots:
        left, quality = budget, 0
        for models in prompts:
            fits = [m for m in models if m[1] <= left]
            pick = min(fits, key=lambda m: (lam * m[1] - m[4], m[1], m[0]), default=None)
            if pick is None or pick[2] > left:
                break
            left, quality = left - pick[2], quality + pick[3]
        else:
            rank = (-quality, budget - left, lam)
            best = rank if best is None or rank < best else best
    return best


def random_ledgers(seed, stable):
    rng = random.Random(seed)
    out = {}
    for k in range(6):
        names = [f"m{i}" for i in range(rng.randint(1, 5))]
        quotes = [rng.choice([10, 20, 20, 35, 60, 90]) for _ in names]
        prompts = []
        for _ in range(rng.randint(1, 14)):
            now = quotes if stable else [rng.choice([5, 10, 20, 35, 60]) for _ in names]
            prompts.append([(m, q, max(0, q + rng.randint(-5, 8)), rng.randint(0, 9) * 10, rng.randint(0, 12) * 8) for m, q in zip(names, now)])
        out[f"s{k}"] = prompts
    return out


@pytest.mark.parametrize("stable,fan,live,tries", [(True, 16, 32, 4), (False, 2, 1, 1), (False, 8, 8, 2)])
def test_equals_a_replay_at_every_root(spark, stable, fan, live, tries):
    ledgers = random_ledgers(7 + fan, stable)
    budgets = {"fast": 120, "premium": 450}
    specs = [TierSpec(t, b * CENT, 0.5) for t, b in budgets.items()]
    got = {
        (r["tier"], r["tag"]): (-int(r["quality_sum"] * 100), int(r["spend"] * 100), Fraction(r["num"], r["den"]))
        for r in tuning.tune_shared_budget(made_log(spark, ledgers), specs, ["tag"], fan, live, tries).collect()
    }
    want = {(t, k): plain_best(p, b) for t, b in budgets.items() for k, p in ledgers.items()}
    assert got and got == {k: v for k, v in want.items() if v is not None}


def test_gives_up_most_lambdas(spark):
    rng = random.Random(3)
    prompts = [
        [(f"m{i}", q, q, min(100, 30 + q // 2 + rng.randint(0, 30)), min(100, 30 + q // 2 + rng.randint(0, 30))) for i, q in enumerate((10, 30, 80))]
        for _ in range(150)
    ]
    spec = TierSpec("fast", 5000 * CENT, 1.0)
    row = tuning.tune_shared_budget(made_log(spark, {"one": prompts}), [spec]).first()
    best = plain_best(prompts, 5000)
    assert (-int(row["quality_sum"] * 100), int(row["spend"] * 100), Fraction(row["num"], row["den"])) == best
    assert row["candidates"] > 60 and row["replayed"] < row["candidates"]


def test_no_feasible_lambda_and_no_rows(spark):
    dear = {"s": [[("a", 50, 50, 10, 10)], [("a", 50, 70, 10, 10)]]}
    spec = TierSpec("fast", 100 * CENT, 1.0)
    assert tuning.tune_shared_budget(made_log(spark, dear), [spec], ["tag"]).isEmpty()
    assert tuning.tune_shared_budget(made_log(spark, {"s": []}), [spec], ["tag"]).isEmpty()
    assert tuning.tune_shared_budget(made_log(spark, {"s": [[]]}), [spec], ["tag"]).isEmpty()
    with pytest.raises(ValueError, match="two pieces"):
        tuning.tune_shared_budget(made_log(spark, dear), [spec], fan=1)


def test_training_without_a_grid_tries_every_lambda(spark, tmp_path):
    pooled = [TierSpec(t.tier, t.budget * 8, t.weight) for t in TIERS]
    free = train(sample_log(spark), pooled, benchmark.LinearConfig(), str(tmp_path / "a"), ledger="cumulative")
    assert set(free.lambdas) == {"fast", "balanced", "premium"}
