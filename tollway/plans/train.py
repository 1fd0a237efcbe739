"""Fitting a deployable predictor and policy on all rows."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.functions import fingerprint
from tollway.functions.encode import FEATURE_NAMES
from tollway.functions.sizing import small_copy
from tollway.operators import lambdas, policies, predict, tuning
from tollway.plans.benchmark import Config, Fitted, Prepared, fit, prepare_fits, tune
from tollway.schema import TierSpec
from tollway.sources import artifacts
from tollway.sources.embeddings import Embedded, attach_prompts


@dataclass(frozen=True)
class Trained:
    prepared: Prepared
    fitted: Fitted
    lambdas: dict[str, tuple[int, int]]
    selection: DataFrame
    predictor_identity: str


def train(
    log: DataFrame,
    tiers: list[TierSpec],
    config: Config,
    path: str,
    ledger: str = "per_query",
    grid: list[tuple[int, int]] | None = None,
    cap: int | None = None,
    embedded: Embedded | None = None,
) -> Trained:
    """Predictor on all rows, calibrated out of fold; lambdas tuned on cross-fitted scores.

    The deployable fit leaves no domain out.  Lambdas come from predictions by the fits
    that never saw a row's own domain, under per-query budgets (full search) or a budget
    shared by the ordered log (exact search, or a given grid).  With ``embedded``, each prompt's vector joins its surface
    features, and the identity of the vectors is saved with the predictor.
    """

    spark = log.sparkSession
    names, identity_of = list(FEATURE_NAMES), None
    if embedded is None:
        p = prepare_fits(log, tiers)
    else:
        identity_of = embedded.identity.to_json()
        names += [f"embedding:{k}" for k in range(embedded.identity.width)]
        p = prepare_fits(attach_prompts(policies.read_texts(log, [], []), embedded), tiers, "embedding", embedded.identity.width)
    base = [0, *p.plan.masks(1), *p.plan.masks(2)]
    fitted = fit(p, config, base, [0, *p.plan.masks(1)])
    crossed = predict.predict_excluding(p.cells, p.plan, fitted.scorer, fitted.calibrators, p.plan.masks(1))
    rows = predict.predict_excluding(p.features, p.plan, fitted.scorer, fitted.calibrators, p.plan.masks(1))
    if ledger == "per_query":
        selection, strategy = tune(p, crossed, [], cap), "exhaustive" if cap is None else "bounded-hash-sample"
    elif ledger == "cumulative":
        if grid:
            selection, strategy = lambdas.tune_cumulative(rows, tiers, grid), "given-grid"
        else:
            selection, strategy = tuning.tune_shared_budget(rows, tiers), "exhaustive"
    else:
        raise ValueError(f"unknown ledger {ledger!r}")
    selection = small_copy(selection, len(tiers), "selections")
    chosen = selection.collect()
    by_tier = {r["tier"]: (int(r["num"]), int(r["den"])) for r in chosen}
    missing = [t.tier for t in tiers if t.tier not in by_tier]
    if missing:
        raise ValueError(f"no fully feasible lambda for tiers {missing}")
    data = artifacts.log_identity(log)
    identity = artifacts.save_predictor(
        spark, f"{path}/predictor", fitted.scorer, fitted.steps, p.profile.model_ids, list(p.plan.domains),
        names, fitted.family, asdict(config), data, identity_of,
    )
    pairs = predict.long_predictions(rows)
    artifacts.save_policy(
        spark, f"{path}/policy", by_tier, tiers, ledger, strategy,
        {
            "predictor": identity, "data": data, "replay": artifacts.order_identity(log),
            "prediction": fingerprint.identity(pairs, ["example_id", "model_id", "predicted_nano"]),
        },
    )
    return Trained(p, fitted, by_tier, selection.withColumn("strategy", F.lit(strategy)), identity)
