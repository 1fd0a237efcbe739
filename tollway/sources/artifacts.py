"""Fitted predictors and tuned policies as tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.functions import fingerprint
from tollway.operators import isotonic
from tollway.operators.prefix import falls
from tollway.operators.scoring import Calibrators, LinearScorer, Scorer, StepTable, StumpScorer
from tollway.schema import TierSpec
from tollway.sources.embeddings import EmbeddingIdentity

FORMAT = 1
LINEAR_ROWS = "mask int, model_id string, weights array<double>, bias double"
STUMP_ROWS = (
    "mask int, model_id string, base double, rate double, "
    "stumps array<struct<feature:int, split:double, left:double, right:double>>"
)
STEP_ROWS = "mask int, model_id string, ub double, value double"
META_ROWS = (
    "format int, family string, model_ids array<string>, domains array<string>, feature_names array<string>, "
    "embedding string, config string, data_identity string"
)
POLICY_ROWS = "tier string, tier_pos int, budget string, weight double, num string, den string"
POLICY_META = (
    "format int, ledger string, strategy string, predictor_identity string, data_identity string, "
    "replay_identity string, prediction_identity string"
)


@dataclass(frozen=True)
class Predictor:
    """A loaded predictor with what it was trained on."""

    scorer: Scorer
    calibrators: Calibrators | StepTable
    model_ids: list[str]
    domains: list[str]
    meta: dict


def _model_rows(scorer: Scorer, model_ids: list[str]) -> tuple[list, str]:
    rows = []
    if isinstance(scorer, LinearScorer):
        for mask, w in sorted(scorer.weights.items()):
            rows += [(mask, m, w[k].tolist(), float(scorer.bias[mask][k])) for k, m in enumerate(model_ids)]
        return rows, LINEAR_ROWS
    for mask, chains in sorted(scorer.stumps.items()):
        rows += [
            (mask, m, float(scorer.base[mask][k]), scorer.rate, [(int(f), float(v), float(a), float(b)) for f, v, a, b in chains[k]])
            for k, m in enumerate(model_ids)
        ]
    return rows, STUMP_ROWS


def predictor_identity(spark: SparkSession, path: str) -> str:
    """Identity of the saved coefficients and steps."""

    models = spark.read.parquet(f"{path}/models")
    parts = [fingerprint.identity(models.select(F.to_json(F.struct(*sorted(models.columns))).alias("row")), ["row"])]
    steps = spark.read.schema(STEP_ROWS).parquet(f"{path}/steps")
    parts.append(fingerprint.identity(steps, ["mask", "model_id", "ub", "value"]))
    return "-".join(parts)


def save_predictor(
    spark: SparkSession,
    path: str,
    scorer: Scorer,
    steps: DataFrame,
    model_ids: list[str],
    domains: list[str],
    feature_names: list[str],
    family: str,
    config: dict,
    data_identity: str,
    embedding: str | None = None,
) -> str:
    """Writes models, steps and one metadata row; returns the predictor's identity.

    ``steps`` has (mask, model_pos, ub, value) and is written as it is, however long.
    """

    rows, schema = _model_rows(scorer, model_ids)
    spark.createDataFrame(rows, schema).write.mode("errorifexists").parquet(f"{path}/models")
    names = F.array(*[F.lit(m) for m in model_ids])
    steps.select("mask", F.get(names, F.col("model_pos")).alias("model_id"), "ub", "value").write.mode(
        "errorifexists"
    ).parquet(f"{path}/steps")
    meta = [(FORMAT, family, model_ids, domains, feature_names, embedding, json.dumps(config, sort_keys=True), data_identity)]
    spark.createDataFrame(meta, META_ROWS).write.mode("errorifexists").parquet(f"{path}/meta")
    return predictor_identity(spark, path)


def _check_embedding(meta: dict, given: EmbeddingIdentity | None) -> None:
    """A predictor of embeddings is used with vectors of the very identity it was trained on, others with none."""

    if meta["embedding"] is None:
        if given is not None:
            raise ValueError("predictor was trained without embeddings")
        return
    saved = EmbeddingIdentity.from_json(meta["embedding"])
    if given is None:
        raise ValueError("predictor needs embeddings of the identity it was trained on")
    for name, value in asdict(saved).items():
        if getattr(given, name) != value:
            raise ValueError(f"predictor was trained with another embedding {name}")


def load_predictor(spark: SparkSession, path: str, embedding: EmbeddingIdentity | None = None) -> Predictor:
    """Reads a saved predictor; fails on another format, missing models or bad numbers.

    ``embedding`` is the identity of the vectors that it will be given; it has to be the saved one.
    """

    meta = spark.read.schema(META_ROWS).parquet(f"{path}/meta").collect()
    if len(meta) != 1 or meta[0]["format"] != FORMAT:
        raise ValueError("not a predictor of this format")
    m = meta[0].asDict()
    _check_embedding(m, embedding)
    width = len(m["feature_names"])
    ids = list(m["model_ids"])
    place = {name: k for k, name in enumerate(ids)}
    if m["family"] == "bilinear":
        rows = spark.read.schema(LINEAR_ROWS).parquet(f"{path}/models").collect()
        weights = {r["mask"]: np.zeros((len(ids), len(r["weights"]))) for r in rows}
        bias = {r["mask"]: np.full(len(ids), np.nan) for r in rows}
        for r in rows:
            weights[r["mask"]][place[r["model_id"]]] = r["weights"]
            bias[r["mask"]][place[r["model_id"]]] = r["bias"]
        if not all(np.isfinite(b).all() and np.isfinite(weights[k]).all() for k, b in bias.items()):
            raise ValueError("predictor has missing or non-finite coefficients")
        if any(w.shape[1] != width for w in weights.values()):
            raise ValueError("predictor has other features than it names")
        scorer: Scorer = LinearScorer(weights, bias)
    else:
        rows = spark.read.schema(STUMP_ROWS).parquet(f"{path}/models").collect()
        base = {r["mask"]: np.full(len(ids), np.nan) for r in rows}
        chains: dict[int, list] = {r["mask"]: [[] for _ in ids] for r in rows}
        for r in rows:
            base[r["mask"]][place[r["model_id"]]] = r["base"]
            chains[r["mask"]][place[r["model_id"]]] = [(s["feature"], s["split"], s["left"], s["right"]) for s in r["stumps"]]
        if any(not 0 <= f < width for models in chains.values() for chain in models for f, *_ in chain):
            raise ValueError("predictor has other features than it names")
        if not all(np.isfinite(b).all() for b in base.values()):
            raise ValueError("predictor has missing base values")
        scorer = StumpScorer(rows[0]["rate"], base, chains)
    steps = spark.read.schema(STEP_ROWS).parquet(f"{path}/steps")
    positions = F.create_map(*[v for k, name in enumerate(ids) for v in (F.lit(name), F.lit(k))])
    calibrators = isotonic.load(steps.withColumn("model_pos", F.element_at(positions, F.col("model_id"))))
    check_steps(calibrators)
    return Predictor(scorer, calibrators, ids, list(m["domains"]), m)


def check_steps(calibrators: Calibrators | StepTable) -> None:
    """Refuses steps whose bounds repeat or whose values fall."""

    if isinstance(calibrators, StepTable):
        disordered = not falls(calibrators.steps, ["mask", "model_pos"], "ub", "value").isEmpty()
    else:
        disordered = any((np.diff(at) <= 0).any() or (np.diff(values) < 0).any() for at, values in calibrators.steps.values())
    if disordered:
        raise ValueError("calibration steps are out of order")


def save_policy(
    spark: SparkSession,
    path: str,
    lambdas: dict[str, tuple[int, int]],
    tiers: list[TierSpec],
    ledger: str,
    strategy: str,
    identities: dict[str, str],
) -> None:
    """Writes the tuned lambdas with the identities of what they were tuned on."""

    rows = [
        (t.tier, pos, str(t.budget), float(t.weight), str(lambdas[t.tier][0]), str(lambdas[t.tier][1]))
        for pos, t in enumerate(tiers)
    ]
    spark.createDataFrame(rows, POLICY_ROWS).coalesce(1).write.mode("errorifexists").parquet(f"{path}/lambdas")
    meta = [(FORMAT, ledger, strategy, *[identities[k] for k in ("predictor", "data", "replay", "prediction")])]
    spark.createDataFrame(meta, POLICY_META).write.mode("errorifexists").parquet(f"{path}/policy")


def load_policy(spark: SparkSession, path: str) -> tuple[dict[str, tuple[int, int]], dict]:
    meta = spark.read.schema(POLICY_META).parquet(f"{path}/policy").collect()
    if len(meta) != 1 or meta[0]["format"] != FORMAT:
        raise ValueError("not a policy of this format")
    rows = spark.read.schema(POLICY_ROWS).parquet(f"{path}/lambdas").orderBy("tier_pos").collect()
    lambdas = {}
    for r in rows:
        num, den = int(r["num"]), int(r["den"])
        if num < 0 or den < 1:
            raise ValueError("lambda must be a non-negative fraction")
        lambdas[r["tier"]] = (num, den)
    return lambdas, {**meta[0].asDict(), "tiers": [r.asDict() for r in rows]}


def verify_policy(spark: SparkSession, path: str, predictor_path: str, log: DataFrame, tiers: list[TierSpec]) -> dict[str, tuple[int, int]]:
    """The saved lambdas, after checking predictor, data, order and tiers against them."""

    lambdas, meta = load_policy(spark, path)
    found = {
        "predictor_identity": predictor_identity(spark, predictor_path),
        "data_identity": log_identity(log),
        "replay_identity": order_identity(log),
    }
    for name, value in found.items():
        if meta[name] != value:
            raise ValueError(f"policy was tuned with another {name.replace('_identity', '')}")
    saved = [(r["tier"], r["budget"], r["weight"]) for r in meta["tiers"]]
    if saved != [(t.tier, str(t.budget), float(t.weight)) for t in tiers]:
        raise ValueError("policy was tuned for other tiers")
    return lambdas


_DATA = ["example_id", "prompt_sha256", "domain", "observable_tag", "model_id", "quoted", "realized", "quality"]


def log_identity(log: DataFrame) -> str:
    return fingerprint.identity(fingerprint.long_models(log), _DATA)


def order_identity(log: DataFrame) -> str:
    return fingerprint.identity(fingerprint.long_models(log), ["ord", *_DATA])
