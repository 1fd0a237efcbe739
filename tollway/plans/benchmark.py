"""Learned policy against the baselines under nested leave-one-domain-out fitting."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.functions.encode import SURFACE_WIDTH, with_features
from tollway.functions.sizing import small_copy
from tollway.operators import cells as cell_ops
from tollway.operators import isotonic, lambdas, metrics, moments, policies, predict, ridge, stumps
from tollway.operators.folds import SubsetPlan
from tollway.operators.ledger import replay
from tollway.operators.moments import Moments
from tollway.operators.profile import Profile, profile
from tollway.operators.scoring import Calibrators, Scorer, StepTable
from tollway.plans.evaluate import baseline_policies, prepare
from tollway.schema import MAX_DOMAINS, TierSpec, with_tiers
from tollway.session import materialize, spread


@dataclass(frozen=True)
class LinearConfig:
    """Ridge heads on standardised features."""

    ridge: float = 1.0
    family: str = "bilinear"

    def fit_base(self, p: Prepared, masks: list[int]) -> Scorer:
        rows = ridge.fit_subsets(p.cells.sparkSession, p.by_domain, p.plan, masks, self.ridge)
        return ridge.load(rows)


@dataclass(frozen=True)
class StumpConfig:
    """Boosted stump heads."""

    rounds: int = stumps.ROUNDS
    rate: float = stumps.RATE
    min_leaf: int = stumps.MIN_LEAF
    min_gain: float = 0.0
    family: str = "stumps"

    def fit_base(self, p: Prepared, masks: list[int]) -> Scorer:
        return stumps.fit(p.cells, p.by_domain, p.plan, masks, self.rounds, self.rate, self.min_leaf, self.min_gain)


class Config(Protocol):
    """A trainer: base fits for training subsets named by the domains they leave out.

    Own trainers implement this; the scorer they return has ``score(x, mask)``,
    ``only(masks)`` and ``size()``.
    """

    family: str

    def fit_base(self, p: Prepared, masks: list[int]) -> Scorer: ...


@dataclass(frozen=True)
class Prepared:
    """Slim feature rows, their cells, and what was counted once for all fits."""

    features: DataFrame
    cells: DataFrame
    plan: SubsetPlan
    profile: Profile
    by_domain: dict[str, Moments]
    width: int
    tiers: list[TierSpec]


@dataclass(frozen=True)
class Fitted:
    scorer: Scorer
    calibrators: Calibrators | StepTable
    steps: DataFrame
    family: str


@dataclass(frozen=True)
class Tuned:
    """Chosen lambda per (outer domain, tier) as (num, den), with the selection rows."""

    by_key: dict[tuple[str, str], tuple[int, int]]
    selection: DataFrame


@dataclass(frozen=True)
class Benchmark:
    results: DataFrame
    card: DataFrame
    tuned: dict[str, Tuned]
    fitted: dict[str, Fitted]
    prepared: Prepared
    names: list[str] = field(default_factory=list)


def prepare_fits(
    log: DataFrame,
    tiers: list[TierSpec],
    embedding: str | None = None,
    embedding_width: int = 0,
    needed: list | None = None,
) -> Prepared:
    """The one pass over the texts, then cells and domain moments.

    The pass keeps features, models and the facts that ``needed`` policies ask for, and
    writes them as a slim table; everything later reads that table and never a text.
    """

    known = profile(log)
    plan = SubsetPlan(tuple(known.domains))
    rows = with_features(log, embedding, embedding_width)
    rows = policies.with_facts(rows, needed or [], [t.tier for t in tiers])
    keep = ["example_id", "ord", "domain", "observable_tag", "models", "x"]
    keep += [c for c in ("_facts",) if c in rows.columns]
    features = spread(materialize(rows.select(*keep), "features"))
    width = SURFACE_WIDTH + embedding_width
    n_models = len(known.model_ids)
    cells = spread(materialize(cell_ops.cells(features, tiers, n_models), "cells"))
    by_domain = moments.load(moments.domain_moments(cells, width, n_models), width, n_models)
    return Prepared(features, cells, plan, known, by_domain, width, tiers)


def fit(p: Prepared, config: Config, base_masks: list[int], contexts: list[int]) -> Fitted:
    """Base fits for all subsets, then one calibrator per context and model."""

    scorer = config.fit_base(p, base_masks)
    steps = materialize(isotonic.fit(isotonic.calibration_pairs(p.cells, scorer, p.plan, contexts)), "steps")
    return Fitted(scorer, isotonic.load(steps), steps, config.family)


def sweep_rows(p: Prepared, predicted: DataFrame) -> DataFrame:
    """Scored cells as lambda-search input, one row per tier."""

    rows = with_tiers(predicted, p.tiers)
    return rows.withColumn("over", F.get("over", "tier_pos")).withColumn(
        "model_ids", F.array(*[F.lit(m) for m in p.profile.model_ids])
    )


def outer_predictions(p: Prepared, f: Fitted) -> DataFrame:
    """Cells scored for every outer fold that trains on them, by a fit that never saw their domain."""

    scored = predict.predict_excluding(p.cells, p.plan, f.scorer, f.calibrators, p.plan.masks(2))
    outer = F.lit(None).cast("string")
    for d in p.plan.domains:
        bit = p.plan.bit(d)
        outer = F.when((F.col("mask").bitwiseAND(F.lit(bit)) != 0) & (F.col("domain") != d), d).otherwise(outer)
    return scored.withColumn("outer", outer)


def tune(
    p: Prepared,
    predicted: DataFrame,
    by: list[str],
    cap: int | None = None,
    grid: dict[str, list[tuple[int, int]]] | None = None,
) -> DataFrame:
    """Selected lambda per (by, tier).

    Without a cap every breakpoint is searched through the metric curve.  With one, a
    bounded hash sample of roots is rank-spaced to the cap and read off the same curve.  A
    given grid (tier to fractions) is read off it too.
    """

    if cap is not None and grid is not None:
        raise ValueError("a cap and a grid exclude each other")
    rows = sweep_rows(p, predicted)
    full = lambdas.curve(lambdas.change_events(rows, by), by)
    if grid is not None:
        for fraction in (f for values in grid.values() for f in values):
            policies.check_lambda(*fraction)
        values = F.array(
            *[
                F.struct(F.lit(t).alias("tier"), F.lit(num).cast("bigint").alias("num"), F.lit(den).cast("bigint").alias("den"))
                for t, values in grid.items() for num, den in values
            ]
        )
        groups = full.select(*by).distinct() if by else full.sparkSession.range(1).select()
        given = groups.select(*by, F.inline(values))
        return lambdas.select_best(
            lambdas.at_grid(full, given.withColumn("key", lambdas.fraction_key(F.col("num"), F.col("den"))), by), by
        )
    if cap is None:
        return lambdas.select_best(full, by)
    scored = F.transform(
        F.arrays_zip("quotes", "predicted"),
        lambda m: F.struct(policies.cost_units(m["quotes"]).alias("c"), m["predicted"].alias("q")),
    )
    points = lambdas.breakpoints(predicted, scored, by)
    sample = lambdas.bounded_roots(points, by, cap)
    spaced = lambdas.rank_spaced(lambdas.exhaustive_candidates(sample, by), by, cap)
    names = F.array(*[F.lit(t.tier) for t in p.tiers])
    return lambdas.select_best(lambdas.at_grid(full, spaced.withColumn("tier", F.explode(names)), by), by)


def tune_outer(
    p: Prepared, f: Fitted, cap: int | None = None, grid: dict[str, list[tuple[int, int]]] | None = None
) -> Tuned:
    selection = small_copy(tune(p, outer_predictions(p, f), ["outer"], cap, grid), 3 * MAX_DOMAINS, "selections")
    rows = selection.collect()
    by_key = {(r["outer"], r["tier"]): (int(r["num"]), int(r["den"])) for r in rows}
    for d in p.plan.domains:
        for t in p.tiers:
            if (d, t.tier) not in by_key:
                raise ValueError(f"no fully feasible lambda for fold {d!r}, tier {t.tier!r}")
    return Tuned(by_key, selection)


def lambda_columns(tuned: Tuned) -> tuple[Column, Column]:
    """The row's fold and tier looked up in a literal map of at most domains x tiers entries."""

    entries = []
    for (d, t), (num, den) in sorted(tuned.by_key.items()):
        entries += [F.lit(f"{d}\x1f{t}"), F.struct(F.lit(num).cast("bigint").alias("num"), F.lit(den).cast("bigint").alias("den"))]
    hit = F.try_element_at(F.create_map(*entries), F.concat(F.col("domain"), F.lit("\x1f"), F.col("tier")))
    return hit["num"], hit["den"]


def held_out_predictions(rows: DataFrame, p: Prepared, f: Fitted) -> DataFrame:
    """Rows scored by the context that left exactly their own domain out."""

    return predict.predict_excluding(rows, p.plan, f.scorer, f.calibrators, p.plan.masks(1)).drop("mask")


def run(
    log: DataFrame,
    tiers: list[TierSpec],
    configs: dict[str, Config],
    cap: int | None = None,
    embedding: str | None = None,
    embedding_width: int = 0,
    seed: int = policies.RANDOM_SEED,
    threshold: int = policies.LENGTH_THRESHOLD,
    grid: dict[str, list[tuple[int, int]]] | None = None,
) -> Benchmark:
    """Baselines and learned policies over one population, replayed in one pass.

    Every learned decision for a domain comes from fits, calibrators and lambdas that never
    read that domain's outcomes.
    """

    baselines = lambda known: baseline_policies(*known.roles(), seed, threshold)
    asked = [policies.seeded_random(seed), policies.length_heuristic("", "", threshold)]
    p = prepare_fits(log, tiers, embedding, embedding_width, asked)
    fitted, tuned, learned = {}, {}, []
    rows, _, _ = prepare(p.features, tiers, p.profile)
    for name, config in configs.items():
        fitted[name] = fit(p, config, p.plan.training_masks(), p.plan.calibration_masks())
        tuned[name] = tune_outer(p, fitted[name], cap, grid)
        column = f"_pred_{len(learned)}"
        rows = held_out_predictions(rows, p, fitted[name]).withColumnRenamed("predicted", column)
        num, den = lambda_columns(tuned[name])
        learned.append(policies.lambda_rule(num, den, name, F.col(column)))
    if len(learned) == 1:
        rows = rows.withColumn("predicted", F.col("_pred_0"))
    results = replay(rows, tiers, [*baselines(p.profile), *learned])
    return Benchmark(results, metrics.scorecard(results), tuned, fitted, p, list(configs))


def fold_router(bench: Benchmark, domain: str, name: str | None = None) -> tuple[Scorer, Calibrators | StepTable, int, dict[str, tuple[int, int]]]:
    """One outer fold's predictor, its context and its lambdas, ready for ``route``."""

    name = name or bench.names[0]
    mask = bench.prepared.plan.bit(domain)
    f = bench.fitted[name]
    prices = {t.tier: bench.tuned[name].by_key[(domain, t.tier)] for t in bench.prepared.tiers}
    return f.scorer.only([mask]), f.calibrators.only([mask]), mask, prices


def compare(bench: Benchmark) -> tuple[DataFrame, DataFrame]:
    """Second family minus first: overall and per held-out domain; no winner is named."""

    left, right = bench.names
    held = metrics.held_out_scores(bench.results)
    as_names = lambda df: df.withColumn(
        "policy", F.when(F.col("policy") == left, "left").when(F.col("policy") == right, "right").otherwise(F.col("policy"))
    )
    return (
        metrics.paired_delta(as_names(bench.card), "left", "right"),
        metrics.paired_delta(as_names(held), "left", "right", ["held_out"]),
    )
