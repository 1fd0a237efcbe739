"""Own providers, predictors, trainers, ledgers and grids; plan shape of the registered queries."""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from samples import MODELS, TIERS, sample_log
from tollway.catalog import load
from tollway.functions.extend import with_embedding, with_predictions
from tollway.operators import policies
from tollway.operators.ledger import per_query_columns, replay
from tollway.operators.moments import combine
from tollway.operators.scoring import LinearScorer
from tollway.plans import benchmark
from tollway.plans.route import route


def test_own_embedding_provider(spark):
    rows = with_embedding(sample_log(spark), lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), 2)
    assert all(r["embedding"] == [float(len(r["prompt"])), 1.0] for r in rows.collect())
    b = benchmark.run(rows, TIERS, {"bilinear": benchmark.LinearConfig()}, embedding="embedding", embedding_width=2)
    assert b.card.count() == 7
    with pytest.raises(Exception, match="shape"):
        with_embedding(sample_log(spark), lambda: lambda texts: np.zeros((len(texts), 3)), 2).collect()


def test_own_predictor(spark):
    ids = sorted(MODELS)
    rows = with_predictions(sample_log(spark), lambda: lambda texts, models: np.array([[0.1 * len(m) for m in models] for _ in texts]), ids)
    got = replay(rows, TIERS[2:], [policies.shared_lambda(0, 1)]).select("decision").distinct().collect()
    assert [r["decision"] for r in got] == ["steady"]


@dataclass(frozen=True)
class MeanTrainer:
    """Predicts each model's training mean."""

    family: str = "means"

    def fit_base(self, p, masks):
        totals = {m: combine(p.by_domain, p.plan.excluded(m)) for m in masks}
        return LinearScorer({m: np.zeros((len(t.sy), p.width)) for m, t in totals.items()}, {m: t.sy / t.n for m, t in totals.items()})


def test_own_trainer_and_given_grid(spark):
    grid = {t.tier: [(0, 1), (1, 2), (1, 1)] for t in TIERS}
    b = benchmark.run(sample_log(spark), TIERS, {"means": MeanTrainer()}, grid=grid)
    assert {v for v in b.tuned["means"].by_key.values()} <= {(0, 1), (1, 2), (1, 1)}
    scorer, steps, mask, prices = benchmark.fold_router(b, "code")
    catalogue = {m: Decimal(q) for m, q in MODELS.items()}
    prompts = sample_log(spark).where("domain = 'code'").select("example_id", "prompt")
    got = route(prompts, catalogue, TIERS, prices, scorer, steps, ["example_id"], mask)
    want = b.results.where("policy = 'means' and domain = 'code'").select("example_id", "tier", "decision")
    assert sorted(map(tuple, got.select("example_id", "tier", "decision").collect())) == sorted(map(tuple, want.collect()))


def test_own_ledger(spark):
    def doubled(models, decision, remaining):
        return per_query_columns(models, decision, (remaining * 2).cast("decimal(28,12)"))

    r = replay(sample_log(spark), TIERS[:1], [policies.always_premium("steady")], doubled)
    assert r.where("feasible").count() == 8


def test_registry_is_complete():
    r = load()
    assert set(r.ORACLES) <= set(r.QUERIES) and len(r.QUERIES) > 90
    covered = {i for c in r.COVERS.values() for i in c.split()}
    wanted = (
        [f"S{i}" for i in range(1, 14)] + [f"P{i}" for i in range(1, 12)] + [f"J{i}" for i in range(1, 16)]
        + [f"A{i}" for i in range(1, 26)] + [f"B{i}" for i in range(1, 13)] + [f"R{i}" for i in range(1, 7)]
        + [f"F{i}" for i in range(1, 11)] + [f"M{i}" for i in range(1, 16)] + [f"L{i}" for i in range(1, 12)]
        + [f"W{i}" for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)] + [f"U{i}" for i in range(1, 5)]
        + [f"ST{i}" for i in range(1, 4)] + [f"K{i}" for i in range(1, 11)]
    )
    assert sorted(set(wanted) - covered) == []


PLANS = ["tier_scores", "domain_table_fit", "cumulative_ledger", "lambda_breakpoints", "surface_features", "quote_error", "balanced_split", "data_identity", "policy_random"]


@pytest.mark.parametrize("name", PLANS)
def test_plans_hold_no_cross_join_and_no_python(spark, sf_dir, name):
    df = load().QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_reports_never_read_the_text(spark, sf_dir):
    df = load().QUERIES["domain_table_fit"](spark, sf_dir)
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert scans and not any("text:string" in line for line in scans)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
