"""The six baselines over one population."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.operators import domain_table, metrics, policies
from tollway.operators.ledger import replay
from tollway.operators.profile import Profile, profile
from tollway.schema import TierSpec

BASELINES = (
    "always-cheapest", "always-premium", "random", "length-heuristic", "oracle", "domain-best-table",
)


@dataclass(frozen=True)
class Evaluation:
    results: DataFrame
    card: DataFrame
    table: DataFrame
    profile: Profile


def baseline_policies(cheapest: str, premium: str, seed: int, threshold: int):
    """The six rules; the domain table reads ``_table`` from the row."""

    return [
        policies.always_cheapest(),
        policies.always_premium(premium),
        policies.seeded_random(seed),
        policies.length_heuristic(cheapest, premium, threshold),
        policies.oracle(),
        policies.domain_table(F.col("_table"), cheapest),
    ]


def prepare(log: DataFrame, tiers: list[TierSpec], known: Profile | None = None) -> tuple[DataFrame, DataFrame, Profile]:
    """Checks the catalogue, fits the domain table and joins it to the rows."""

    known = known or profile(log)
    known.roles()
    if len(known.domains) < 2:
        raise ValueError("leaving one domain out needs at least two domains")
    table = domain_table.fit(log, tiers, known.domains)
    return domain_table.attach(log, table), table, known


def baseline_results(
    log: DataFrame,
    tiers: list[TierSpec],
    seed: int = policies.RANDOM_SEED,
    threshold: int = policies.LENGTH_THRESHOLD,
    extra: list | None = None,
) -> DataFrame:
    rows, _, known = prepare(log, tiers)
    return replay(rows, tiers, [*baseline_policies(*known.roles(), seed, threshold), *(extra or [])])


def evaluate(
    log: DataFrame,
    tiers: list[TierSpec],
    seed: int = policies.RANDOM_SEED,
    threshold: int = policies.LENGTH_THRESHOLD,
) -> Evaluation:
    """Scorecard of the six baselines with leave-one-domain-out table fits.

    Three column-pruned passes: profile, table sums, replay.  Each ends in a small
    map-side combined aggregate; no pass shuffles the rows themselves.
    """

    rows, table, known = prepare(log, tiers)
    results = replay(rows, tiers, baseline_policies(*known.roles(), seed, threshold))
    return Evaluation(results, metrics.scorecard(results), table, known)
