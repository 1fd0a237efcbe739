"""Batch and streaming choice for prompts that have no logged outcome."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.functions.encode import with_features
from tollway.functions.surface import with_flags
from tollway.operators import checks, policies, predict
from tollway.operators.scoring import Calibrators, Scorer, StepTable
from tollway.schema import COST, TierSpec, with_tiers
from tollway.sources.embeddings import Embedded, attach_prompts


def catalogue_array(catalogue: dict[str, Decimal]):
    return F.array(
        *[
            F.struct(F.lit(m).alias("model_id"), F.lit(q).cast(COST).alias("quoted"))
            for m, q in sorted(catalogue.items())
        ]
    )


def route(
    prompts: DataFrame,
    catalogue: dict[str, Decimal],
    tiers: list[TierSpec],
    lambdas: dict[str, tuple[int, int]] | None = None,
    scorer: Scorer | None = None,
    calibrators: Calibrators | StepTable | None = None,
    keep: list[str] | None = None,
    mask: int = 0,
    embedded: Embedded | None = None,
) -> DataFrame:
    """A decision per prompt and tier: model, quote, predicted quality, refusal reason.

    ``prompts`` has ``prompt``, any ``keep`` columns, and optionally ``remaining`` (what is
    left of the tier's budget, never more than it).  ``mask`` names the fitted context; 0 is
    the one on all rows.  A predictor of embeddings needs ``embedded``, whose identity
    ``load_predictor`` has compared.  Without a fitted scorer the demonstration rule's closed
    form predicts.
    """

    rows = prompts.withColumn("candidates", catalogue_array(catalogue))
    if scorer is not None and embedded is not None:
        rows = rows if "prompt" in (keep or []) else policies.read_texts(rows, [], [])
        rows = with_features(attach_prompts(rows, embedded), "embedding", embedded.identity.width)
        rows = predict.predict_all(rows, scorer, calibrators, mask)
    elif scorer is not None:
        rows = predict.predict_all(with_features(rows), scorer, calibrators, mask)
    else:
        rows = with_flags(rows).withColumn("predicted", policies.demo_predictions(F.col("candidates")))
    rows = with_tiers(rows, tiers)
    left = F.col("budget")
    if "remaining" in prompts.columns:
        too_much = F.raise_error(F.lit("remaining cannot exceed the tier budget")).cast(COST)
        left = F.when(F.col("remaining") > left, too_much).otherwise(F.coalesce("remaining", "budget"))
    view = policies.Visible(
        F.col("candidates"), F.col("prompt"), F.lit(None).cast("string"), F.col("tier"), F.col("tier_pos"), left, F.col("predicted")
    )
    rule = policies.tier_lambda(lambdas or policies.DEMO_LAMBDAS)
    rows = rows.withColumn("decision", rule.choose(view))
    place = F.array_position(F.transform("candidates", lambda m: m["model_id"]), F.col("decision"))
    predicted = F.when(place > 0, F.try_element_at("predicted", place.cast("int")))
    return rows.select(
        *(keep or []), "tier", "decision", policies.quote_of(F.col("candidates"), F.col("decision")).alias("quoted"),
        predicted.alias("predicted_nano"),
        checks.decision_check(F.col("decision"), F.col("candidates"), left).alias("error"),
    )
