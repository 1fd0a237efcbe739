"""Model-choice rules as column expressions over one row's candidate array.

A row of the log carries all its candidates, so choosing one is a narrow expression: no
group-by, no shuffle, any number of policies and tiers in one pass.  Ordinary policies see
only :class:`Visible`; outcomes are handed to privileged ones alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.functions.surface import with_flags, with_hash, with_tags

# Lambdas (numerator, denominator) of the demonstration rule per tier.
DEMO_LAMBDAS = {"fast": (4, 5), "balanced": (7, 20), "premium": (2, 25)}
# Defaults of the baseline suite.
RANDOM_SEED = 2026
LENGTH_THRESHOLD = 120


@dataclass(frozen=True)
class Visible:
    """What a deployable policy may read."""

    candidates: Column  # array<struct<model_id, quoted>>
    prompt: Column
    observable_tag: Column
    tier: Column
    tier_pos: Column
    remaining: Column
    predicted: Column | None = None  # array<bigint>, billionths, aligned with candidates
    facts: dict[str, Column] = field(default_factory=dict)


# A fact is worked out once per prompt, before tiers and policies multiply the rows.  It
# reads the prompt columns of ``with_flags`` and gets the tier names in order.
Fact = Callable[[list[str]], Column]


@dataclass(frozen=True)
class Policy:
    """A named choice; one that reads ``prompt`` itself, not only facts, must say so."""

    name: str
    choose: Callable[[Visible], Column]
    facts: dict[str, Fact] = field(default_factory=dict)
    reads_prompt: bool = False


@dataclass(frozen=True)
class PrivilegedPolicy:
    """May read outcomes (array<struct<model_id, quoted, realized, quality>>)."""

    name: str
    choose: Callable[[Visible, Column], Column]
    facts: dict[str, Fact] = field(default_factory=dict)
    reads_prompt: bool = False


def with_facts(log: DataFrame, policies: list[Policy | PrivilegedPolicy], tier_names: list[str]) -> DataFrame:
    """Adds the policies' facts as one struct ``_facts``; a narrow step.

    Facts already on the rows are kept, and the text is read only when one is missing.
    """

    wanted = {name: fact for p in policies for name, fact in p.facts.items()}
    have = set(log.schema["_facts"].dataType.names) if "_facts" in log.columns else set()
    missing = {name: fact for name, fact in wanted.items() if name not in have}
    if not missing:
        return log
    kept = [F.col(f"_facts.{name}") for name in sorted(have)]
    added = [fact(tier_names).alias(name) for name, fact in sorted(missing.items())]
    columns = [c for c in log.columns if c != "_facts"]
    flags = [c for c in ("n_char", "n_word", "n_line", "has_code", "has_math", "_low", "_hangul") if c not in columns]
    rows = with_flags(log) if flags else log
    return rows.select(*columns, F.struct(*kept, *added).alias("_facts"))


def read_texts(log: DataFrame, policies: list[Policy | PrivilegedPolicy], tier_names: list[str]) -> DataFrame:
    """The rows without ``prompt``: its surface features, hash and the policies' facts stand for it.

    For rows that meet a join by a key or a hash, which then moves no text; a narrow step.
    """

    return with_tags(with_facts(with_flags(with_hash(log)), policies, tier_names)).drop("prompt")


def fact_columns(log: DataFrame) -> dict[str, Column]:
    if "_facts" not in log.columns:
        return {}
    return {name: F.col(f"_facts.{name}") for name in log.schema["_facts"].dataType.names}


def router_view(log: DataFrame) -> DataFrame:
    """The deployable projection: an opaque key, no labels, no outcomes, no IDs."""

    return log.select(
        F.sha2(F.concat(F.lit("row\x00"), "example_id"), 256).alias("row_key"),
        "prompt",
        "observable_tag",
        visible_candidates(F.col("models")).alias("candidates"),
    )


def visible_candidates(models: Column) -> Column:
    return F.transform(
        models, lambda m: F.struct(m["model_id"].alias("model_id"), m["quoted"].alias("quoted"))
    )


def observable_tag(domain: Column, observable: Column) -> Column:
    return F.when(observable, domain)


def affordable(candidates: Column, remaining: Column) -> Column:
    return F.filter(candidates, lambda m: m["quoted"] <= remaining)


def affordable_both(models: Column, remaining: Column) -> Column:
    return F.filter(models, lambda m: (m["quoted"] <= remaining) & (m["realized"] <= remaining))


def _first_by(items: Column, *keys: Callable[[Column], Column]) -> Column:
    """Model with the smallest key tuple, ties to the smaller ID; null for no items."""

    ranked = F.transform(
        items,
        lambda m: F.struct(
            *[key(m).alias(f"k{i}") for i, key in enumerate(keys)], m["model_id"].alias("model_id")
        ),
    )
    return F.array_min(ranked)["model_id"]


def cheapest_of(candidates: Column) -> Column:
    return _first_by(candidates, lambda m: m["quoted"])


def dearest_of(candidates: Column) -> Column:
    ranked = F.transform(
        candidates, lambda m: F.struct(m["quoted"].alias("q"), m["model_id"].alias("model_id"))
    )
    return F.array_max(ranked)["model_id"]


def quote_of(candidates: Column, model_id: Column) -> Column:
    hit = F.filter(candidates, lambda m: m["model_id"] == model_id)
    return F.try_element_at(hit, F.lit(1))["quoted"]


def always_cheapest() -> Policy:
    return Policy("always-cheapest", lambda v: cheapest_of(v.candidates))


def always_premium(model_id: str) -> Policy:
    return Policy("always-premium", lambda v: F.lit(model_id))


def seeded_random(seed: int = RANDOM_SEED) -> Policy:
    fact = f"draw_{seed}"

    def draws(tier_names: list[str]) -> Column:
        def one(tier: str) -> Column:
            text = F.concat(F.lit(f"{seed}\x00"), F.col("prompt"), F.lit(f"\x00{tier}"))
            return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")

        return F.array(*[one(t) for t in tier_names])

    def choose(v: Visible) -> Column:
        ids = F.array_sort(F.transform(affordable(v.candidates, v.remaining), lambda m: m["model_id"]))
        count = F.greatest(F.size(ids), F.lit(1)).cast("decimal(10,0)")
        place = (F.get(v.facts[fact], v.tier_pos) % count).cast("int") + 1
        return F.coalesce(F.try_element_at(ids, place), cheapest_of(v.candidates))

    return Policy("random", choose, {fact: draws})


def length_heuristic(cheap_id: str, strong_id: str, threshold: int = LENGTH_THRESHOLD) -> Policy:
    if threshold < 1:
        raise ValueError("threshold must be positive")
    fact = f"hard_{threshold}"

    def hard(tier_names: list[str]) -> Column:
        return (F.col("n_char") >= threshold) | F.col("has_code") | F.col("has_math")

    def choose(v: Visible) -> Column:
        fits = quote_of(v.candidates, F.lit(strong_id)) <= v.remaining
        return F.when(v.facts[fact] & fits, F.lit(strong_id)).otherwise(F.lit(cheap_id))

    return Policy("length-heuristic", choose, {fact: hard})


def oracle() -> PrivilegedPolicy:
    """Best observed quality among models that fit by quote and by charge."""

    def choose(v: Visible, models: Column) -> Column:
        fits = affordable_both(models, v.remaining)
        return _first_by(fits, lambda m: -m["quality"], lambda m: m["realized"])

    return PrivilegedPolicy("oracle", choose)


def domain_table(table: Column, fallback_id: str) -> Policy:
    """``table`` maps tier to model for this row's fold and tag; null when it has no entry."""

    def choose(v: Visible) -> Column:
        listed = F.coalesce(F.try_element_at(table, v.tier), F.lit(fallback_id))
        too_dear = quote_of(v.candidates, listed) > v.remaining
        rescue = quote_of(v.candidates, F.lit(fallback_id)) <= v.remaining
        return F.when(too_dear & rescue, F.lit(fallback_id)).otherwise(listed)

    return Policy("domain-best-table", choose)


def scheduled(name: str, decision: Column) -> Policy:
    """Replays decisions made elsewhere, already joined to the row."""

    return Policy(name, lambda v: decision)


def cost_units(cost: Column) -> Column:
    """Cost as a whole number of 1e-12 units; the input check keeps it below 10."""

    return (cost * 1000000000000).cast("decimal(13,0)")


def nano(prediction: Column) -> Column:
    """Predicted quality in whole billionths, the unit all tie-breaks use."""

    out_of_range = F.isnan(prediction) | (F.abs(prediction) >= 10)
    return F.when(
        out_of_range, F.raise_error(F.lit("prediction must be finite and below 10 in size"))
    ).otherwise(F.round(prediction * 1e9, 0).cast("bigint"))


def exact_utility(nano_quality: Column, quoted: Column, num: Column, den: Column) -> Column:
    """quality - (num/den) * cost, times den * 1e12: a whole number, so ties are exact."""

    quality_part = (den.cast("decimal(13,0)") * 1000).cast("decimal(16,0)") * nano_quality.cast("decimal(11,0)")
    cost_part = num.cast("decimal(14,0)") * cost_units(quoted)
    return quality_part.cast("decimal(38,0)") - cost_part.cast("decimal(38,0)")


def lambda_rule(num: Column, den: Column, name: str = "tuned-lambda", predicted: Column | None = None) -> Policy:
    """Affordable model with the largest exact utility, then lower quote, then ID."""

    def choose(v: Visible) -> Column:
        scored = F.zip_with(
            v.candidates,
            v.predicted if predicted is None else predicted,
            lambda m, q: F.struct(m["model_id"].alias("model_id"), m["quoted"].alias("quoted"), q.alias("q")),
        )
        fits = affordable(scored, v.remaining)
        return _first_by(
            fits, lambda m: -exact_utility(m["q"], m["quoted"], num, den), lambda m: m["quoted"]
        )

    return Policy(name, choose)


def shared_lambda(num: int, den: int, name: str = "shared-lambda") -> Policy:
    check_lambda(num, den)
    return lambda_rule(F.lit(num), F.lit(den), name)


def tier_lambda(by_tier: dict[str, tuple[int, int]], name: str = "tier-lambda") -> Policy:
    def pick(part: int, tier: Column) -> Column:
        value = F.lit(None).cast("bigint")
        for label, fraction in by_tier.items():
            value = F.when(tier == label, F.lit(fraction[part])).otherwise(value)
        return value

    for fraction in by_tier.values():
        check_lambda(*fraction)
    return Policy(name, lambda v: lambda_rule(pick(0, v.tier), pick(1, v.tier)).choose(v))


def check_lambda(num: int, den: int) -> None:
    if not (isinstance(num, int) and isinstance(den, int)) or num < 0 or den < 1:
        raise ValueError("lambda must be a non-negative fraction of whole numbers")
    if num >= 10**14 or den >= 10**13:
        raise ValueError("lambda has too many digits; rescale costs or qualities first")


def demo_predictions(candidates: Column) -> Column:
    """Closed-form illustrative quality per candidate, in billionths, for rows of ``with_flags``.

    Longer, multi-line, code and math prompts are harder; dearer models lose less.
    """

    order = F.array_sort(
        F.transform(candidates, lambda m: F.struct(m["quoted"].alias("q"), m["model_id"].alias("model_id")))
    )
    last = F.greatest(F.size(candidates) - 1, F.lit(1)).cast("double")
    difficulty = F.least(
        F.lit(1.0),
        F.col("n_char") / F.lit(500.0)
        + F.lit(0.22) * F.col("has_code").cast("double")
        + F.lit(0.22) * F.col("has_math").cast("double")
        + F.lit(0.02) * F.greatest(F.col("n_line") - 1, F.lit(0)).cast("double"),
    )

    def one(m: Column) -> Column:
        place = F.array_position(order, F.struct(m["quoted"].alias("q"), m["model_id"].alias("model_id")))
        rank = (place - 1).cast("double") / last
        easy = F.lit(0.82) + F.lit(0.12) * rank
        loss = F.lit(0.42) - F.lit(0.38) * rank
        return nano(F.greatest(F.lit(0.0), F.least(F.lit(1.0), easy - loss * difficulty)))

    return F.transform(candidates, one)


def static_predictions(log: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``predicted`` from a given (model_id, score) table of at most a few thousand rows."""

    from tollway.schema import MAX_MODELS_PER_EXAMPLE

    rows = table.select("model_id", F.col("score").cast("double")).limit(MAX_MODELS_PER_EXAMPLE + 1).collect()
    if len(rows) > MAX_MODELS_PER_EXAMPLE:
        raise ValueError("static score table is longer than a model catalogue")
    scores = F.create_map(*[F.lit(v) for r in rows for v in (r[0], float(r[1]))])
    return log.withColumn(
        "predicted", F.transform("models", lambda m: nano(F.element_at(scores, m["model_id"])))
    )
