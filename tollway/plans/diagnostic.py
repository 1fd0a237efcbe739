"""Diagnostics on a wide benchmark log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators import checks, policies, splits
from tollway.operators.ledger import replay
from tollway.operators.metrics import tier_scores
from tollway.plans.benchmark import Benchmark, Config, run
from tollway.schema import TierSpec
from tollway.session import materialize
from tollway.sources import wide


@dataclass(frozen=True)
class Diagnostic:
    benchmark: Benchmark
    tiers: list[TierSpec]
    counts: DataFrame


def balanced_diagnostic(
    table: DataFrame,
    revision: str,
    configs: dict[str, Config],
    calibrate: int = splits.CALIBRATION_PER_DOMAIN,
    evaluate: int = splits.EVALUATION_PER_DOMAIN,
    cap: int | None = None,
    blank_prompts: bool = False,
) -> Diagnostic:
    """Nested benchmark on the evaluation share of every domain, quotes from calibration rows only.

    ``table`` is a wide log with ``ord``; ``calibrate`` to ``evaluate`` is the proportion.
    Every breakpoint of lambda is searched unless ``cap`` asks for a sample.  Quotes are the calibration rows' largest
    charges; an evaluation charge above its quote stops the run before any fit.  A blank prompt is an
    error unless ``blank_prompts`` allows it.
    """

    wide.require_valid(table, blank_prompts)
    scoped = table.withColumn("domain", wide.eval_domain(F.col("eval_name")))
    counts = splits.domain_counts(scoped)
    inside = scoped.where("domain is not null").withColumn("example_id", F.col("sample_id"))
    split = materialize(splits.share_split(inside, revision, calibrate, evaluate), "balanced-split")
    chosen = split.where("role = 'calibration'").select(*table.columns)
    quotes = wide.quote_map(wide.max_quotes(wide.to_long(chosen)))
    tiers = wide.diagnostic_tiers(quotes)
    log = wide.to_log(split.where("role = 'evaluation'").select(*table.columns), quotes)
    # texts are read before the rows are moved to be numbered
    asked = [policies.seeded_random(), policies.length_heuristic("", "")]
    log = materialize(policies.read_texts(log, asked, [t.tier for t in tiers]), "balanced-texts")
    log = materialize(splits.surrogate_ids(log, "evaluation-"), "balanced-evaluation")
    checks.require_empty(checks.quote_underruns(log), "evaluation charge above its calibration quote")
    return Diagnostic(run(log, tiers, configs, cap), tiers, counts)


def prefix_replay(table: DataFrame, one_in: int = splits.PREFIX_ONE_IN, blank_prompts: bool = False) -> DataFrame:
    """Cheapest-model smoke replay of a log in source order with mean quotes.

    The first part in ``one_in`` gives the quotes, all other rows are replayed under one
    budget that covers the cheapest model's quote and largest charge.  Texts are checked, then left
    behind: numbering moves the rows, and neither quotes nor the cheapest model's replay read one.
    A blank prompt is an error unless ``blank_prompts`` allows it.
    """

    wide.require_valid(table, blank_prompts)
    scoped = table.withColumn("domain", wide.eval_domain(F.col("eval_name"))).where("domain is not null")
    first = materialize(splits.prefix_split(wide.without_texts(scoped), one_in), "prefix")
    chosen = first.where("role = 'calibration'").select(*table.columns)
    quotes = wide.quote_map(wide.mean_quotes(wide.to_long(chosen)))
    log = wide.to_log(first.where("role = 'evaluation'").select(*table.columns), quotes)
    cheapest = min(quotes, key=lambda m: (quotes[m], m))
    top = log.select(F.explode("models").alias("m")).where(F.col("m.model_id") == cheapest).agg(F.max("m.realized").alias("x")).first()["x"]
    if top is None:
        raise ValueError("no rows left to replay")
    tier = TierSpec("fast", max(top, quotes[cheapest]), 1.0)
    return tier_scores(replay(log, [tier], [policies.always_cheapest()]))
