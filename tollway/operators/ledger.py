"""Budget replay: what a decision costs and whether it stays within the budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollway.functions import sizing
from tollway.operators.policies import (
    Policy, PrivilegedPolicy, Visible, fact_columns, visible_candidates, with_facts,
)
from tollway.operators.prefix import range_bounds, running_totals
from tollway.schema import COST, COST_SUM, TierSpec, cost_lit, with_tiers
from tollway.session import materialize


def _zero() -> Column:
    return cost_lit(0)


def per_query_columns(models: Column, decision: Column, remaining: Column) -> dict[str, Column]:
    """Outcome of one call against a budget that starts fresh for this query.

    A decision for no model, an unknown model, or a quote above the budget is refused and
    charges nothing.  A charge above the budget is recorded and makes the query infeasible.
    """

    hit = F.try_element_at(F.filter(models, lambda m: m["model_id"] == decision), F.lit(1))
    quoted, realized, quality = hit["quoted"], hit["realized"], hit["quality"]
    refused = decision.isNull() | hit.isNull() | (quoted > remaining)
    within = realized <= remaining
    error = (
        F.when(decision.isNull(), "nothing affordable")
        .when(hit.isNull(), "unknown model")
        .when(quoted > remaining, "quote above what is left")
        .when(~within, "charge above what was left")
    )
    return {
        "call_made": ~refused,
        "quoted": F.when(~refused, quoted),
        "cost": F.when(~refused, realized).otherwise(_zero()),
        "remaining_before": remaining,
        "remaining_after": F.when(refused, remaining)
        .when(within, (remaining - realized).cast(COST))
        .otherwise(_zero()),
        "within_budget": F.when(~refused, within),
        "feasible": ~refused & within,
        "selected_model_id": F.when(~refused & within, decision),
        "quality": F.when(~refused & within, quality),
        "error": error,
    }


def visible(rows: DataFrame, remaining: Column) -> Visible:
    """The deployable view of replay rows; slim rows may come without their text."""

    return Visible(
        candidates=visible_candidates(F.col("models")),
        prompt=F.col("prompt") if "prompt" in rows.columns else F.lit(None).cast("string"),
        observable_tag=F.col("observable_tag"),
        tier=F.col("tier"),
        tier_pos=F.col("tier_pos"),
        remaining=remaining,
        predicted=F.col("predicted") if "predicted" in rows.columns else None,
        facts=fact_columns(rows),
    )


RESULT_COLUMNS = [
    "policy", "tier", "tier_pos", "weight", "budget", "example_id", "ord", "domain", "decision",
    "predicted_nano", "call_made", "quoted", "cost", "remaining_before", "remaining_after",
    "within_budget", "feasible", "selected_model_id", "quality", "error",
]


Ledger = Callable[[Column, Column, Column], dict[str, Column]]


def replay(
    log: DataFrame,
    tiers: list[TierSpec],
    policies: list[Policy | PrivilegedPolicy],
    ledger: Ledger = per_query_columns,
) -> DataFrame:
    """Query results of all policies on all tiers under per-query budgets.

    Narrow from end to end: one input row fans out to tiers and policies in place.
    A ``predicted`` array column, when there is one, is offered to the policies.  Another
    ``ledger`` maps models, decision and budget to the same result columns.
    """

    has_predictions = "predicted" in log.columns
    rows = with_tiers(with_facts(log, policies, [t.tier for t in tiers]), tiers)
    models, budget = F.col("models"), F.col("budget")
    view = visible(rows, budget)
    chosen = [
        F.struct(
            F.lit(p.name).alias("policy"),
            (p.choose(view, models) if isinstance(p, PrivilegedPolicy) else p.choose(view)).alias("decision"),
        )
        for p in policies
    ]
    rows = rows.withColumn("_p", F.explode(F.array(*chosen)))
    rows = rows.withColumn("policy", F.col("_p.policy")).withColumn("decision", F.col("_p.decision"))
    place = F.array_position(F.transform("models", lambda m: m["model_id"]), F.col("decision"))
    shown = F.lit(None).cast("bigint")
    if has_predictions:
        shown = F.when(place > 0, F.try_element_at("predicted", place.cast("int")))
    rows = rows.withColumn("predicted_nano", shown)
    return rows.withColumns(ledger(models, F.col("decision"), budget)).select(*RESULT_COLUMNS)


def replay_schedule(log: DataFrame, tiers: list[TierSpec], schedule: DataFrame, name: str) -> DataFrame:
    """Replays decisions from a (tier, example_id, model_id) table; a missing one is refused.

    Two different decisions for one tier and example are an error.
    """

    def planned(tier: str) -> Column:
        mine = F.when(F.col("tier") == tier, F.col("model_id"))
        clash = F.raise_error(F.lit("a schedule has two decisions for one query"))
        return F.when(F.min(mine) != F.max(mine), clash).otherwise(F.min(mine))

    plan = F.create_map(*[v for t in tiers for v in (F.lit(t.tier), planned(t.tier))])
    rows = log.join(schedule.groupBy("example_id").agg(plan.alias("_plan")), "example_id", "left")
    from tollway.operators.policies import scheduled

    return replay(rows, tiers, [scheduled(name, F.try_element_at(F.col("_plan"), F.col("tier")))])


def cumulative(
    calls: DataFrame,
    keys: list[str],
    order: str,
    cost: str,
    limit: Column,
    bounds: list[float] | None = None,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """Shared budget over an executed, ordered call log.

    With S the running charge, a call is over budget when S exceeds the limit and its own
    charge is positive, and what remains is the positive part of limit - S.
    """

    spent = running_totals(calls, keys, order, {"spent": F.col(cost).cast(COST_SUM)}, bounds, tie_break)
    lim, s, c = limit.cast(COST_SUM), F.col("spent").cast(COST_SUM), F.col(cost).cast(COST_SUM)
    return spent.withColumns(
        {
            "spent": s,
            "remaining_before": F.greatest(lim - (s - c), F.lit(0)).cast(COST_SUM),
            "remaining_after": F.greatest(lim - s, F.lit(0)).cast(COST_SUM),
            "over": (s > lim) & (c > 0),
        }
    )


def budget_report(results: DataFrame, ledger: str = "per_query") -> DataFrame:
    """Limits, spend and overspent calls per policy and tier."""

    count = F.count(F.lit(1))
    limit = F.first("budget")
    effective = limit * count.cast("decimal(18,0)") if ledger == "per_query" else limit
    return results.groupBy("policy", "tier").agg(
        F.lit(ledger).alias("ledger"),
        limit.cast(COST_SUM).alias("configured_limit"),
        effective.cast(COST_SUM).alias("effective_limit"),
        F.sum("cost").cast(COST_SUM).alias("spent"),
        F.count_if(~F.col("within_budget")).alias("over_budget_calls"),
        count.alias("n_queries"),
    )


def multi_call(calls: DataFrame, tiers_by_row: str = "budget", max_calls: int = 1) -> DataFrame:
    """Several calls per query against that query's own budget.

    ``calls`` has policy, tier, example_id, call_idx, model_id, quoted, realized, quality,
    budget and ``selected`` (true on the call whose output is kept).  A query ends at its
    first refused or overspending call, or when it asks for more calls than allowed.
    ``call_idx`` counts a query's calls from zero; a call past the first forbidden one can
    never run, so a group holds at most ``max_calls + 1`` rows.
    """

    calls = calls.where(F.col("call_idx") <= max_calls)

    keys = ["policy", "tier", "example_id"]
    order = Window.partitionBy(*keys).orderBy("call_idx")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.col(tiers_by_row)
    rows = calls.withColumn("_before", F.coalesce(F.sum("realized").over(earlier), F.lit(0)).cast(COST_SUM))
    left = F.greatest(budget - F.col("_before"), F.lit(0)).cast(COST_SUM)
    rows = rows.withColumns(
        {
            "remaining_before": left,
            "_refused": (F.col("quoted") > left) | (F.row_number().over(order) > max_calls),
        }
    ).withColumn("_over", ~F.col("_refused") & (F.col("realized") > F.col("remaining_before")))
    stop = F.max((F.col("_refused") | F.col("_over")).cast("int"))
    rows = rows.withColumn("_stopped", F.coalesce(stop.over(earlier), F.lit(0)) == 1)
    live = ~F.col("_stopped")
    charged = live & ~F.col("_refused")
    kept = charged & ~F.col("_over")
    return rows.groupBy(*keys).agg(
        F.count_if(charged).alias("n_calls"),
        F.sum(F.when(charged, F.col("realized")).otherwise(_zero())).cast(COST_SUM).alias("cost"),
        F.bool_and(kept).alias("feasible"),
        F.when(F.bool_and(kept), F.max(F.when(F.col("selected"), F.col("model_id")))).alias("selected_model_id"),
        F.when(F.bool_and(kept), F.max(F.when(F.col("selected"), F.col("quality")))).alias("quality"),
    )


def settle(
    pending: DataFrame, state: DataFrame, keys: list[str], policies: list[Policy | PrivilegedPolicy], keep: list[str] | None = None
) -> DataFrame:
    """Decisions of rows whose ledger balance decides what can be chosen.

    ``pending`` is a written table of rows with the ledger ``keys``, ``policy``, ``ord``
    (unique per ledger) and log columns; ``state`` gives each ledger's ``balance`` and the
    last settled ``pos``.  Returns keys, example_id, ord, the columns to ``keep``, ``_d`` (decision),
    ``_c`` (charge), ``_r`` (balance before the row) and ``models`` with the decided one alone, so
    that nobody joins the wide rows again.

    A balance only falls, so the log is settled in rounds.  A round lets each ledger keep
    its current balance's choices, adds up the charges as a distributed running total, and
    keeps every row before the first one whose choice differs under its true balance.  For
    a choice to differ a quote level must have been crossed, so with a stable catalogue
    there are at most M + 1 rounds; without one the rounds go on until every ledger is
    finished.  No ledger is ever gathered in one task.  Balances and first differing rows, one
    per ledger, are sent to all tasks while they are few; the rows are shuffled once a round.
    """

    def choice(balance: Column) -> Column:
        view = visible(pending, balance.cast(COST_SUM))
        out = F.lit(None).cast("string")
        for p in policies:
            picked = p.choose(view, F.col("models")) if isinstance(p, PrivilegedPolicy) else p.choose(view)
            out = F.when(F.col("policy") == p.name, picked).otherwise(out)
        return out

    def charge(decision: Column, balance: Column) -> Column:
        """Charge of the decision, zero when it is refused."""

        hit = F.try_element_at(F.filter("models", lambda m: m["model_id"] == decision), F.lit(1))
        return F.when(hit["quoted"] <= balance, hit["realized"]).otherwise(_zero()).cast(COST_SUM)

    fields = [*dict.fromkeys([*keys, "example_id", "ord", *(keep or [])]), "_d", "_c", "_r", "models"]
    decided = F.slice(F.filter("models", lambda m: m["model_id"] == F.col("_d")), 1, 1).alias("models")
    bounds = range_bounds(pending, "ord")
    state, _ = sizing.settle(state)
    settled: DataFrame | None = None
    while True:
        live = pending.join(state, keys).where(F.col("ord") > F.col("pos"))
        guess = live.withColumn("_d", choice(F.col("balance"))).withColumn(
            "_c", charge(F.col("_d"), F.col("balance"))
        )
        summed = running_totals(guess, keys, "ord", {"_s": F.col("_c")}, bounds)
        true_balance = F.greatest(F.col("balance") - (F.col("_s") - F.col("_c")), F.lit(0)).cast(COST_SUM)
        checked = summed.withColumn("_r", true_balance).withColumn("_d2", choice(F.col("_r")))
        checked = checked.withColumn("_c2", charge(F.col("_d2"), F.col("_r")))
        same = F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_c") == F.col("_c2"))
        checked = materialize(checked.select(*fields[:-1], decided, same.alias("_ok")), "ledger-round")
        # Ledgers without a differing row are finished and leave the state.
        cut = checked.where(~F.col("_ok")).groupBy(*keys).agg(F.min(F.struct("ord", "_r")).alias("_cut"))
        cut, _ = sizing.settle(cut)
        kept = checked.join(cut, keys, "left").where(F.col("_cut").isNull() | (F.col("ord") < F.col("_cut.ord")))
        kept = kept.select(*fields)
        settled = kept if settled is None else settled.unionByName(kept)
        state = cut.select(*keys, F.col("_cut._r").alias("balance"), (F.col("_cut.ord") - 1).alias("pos"))
        if state.isEmpty():
            return settled


def sequential_replay(
    log: DataFrame,
    tiers: list[TierSpec],
    policies: list[Policy | PrivilegedPolicy],
    ledger_keys: list[str] | None = None,
) -> DataFrame:
    """Shared-budget replay: query results when what is left decides the next choice.

    One ledger per policy, tier and value of the ledger keys; see :func:`settle`.
    """

    extra = [k for k in (ledger_keys or []) if k not in RESULT_COLUMNS]
    keys = ["policy", "tier", *(ledger_keys or [])]
    fields = ["example_id", "ord", "domain", "observable_tag", "models", *(ledger_keys or [])]
    facts = with_facts(log, policies, [t.tier for t in tiers])
    fields += [c for c in ("predicted", "_facts") if c in facts.columns]
    # The text is carried through the rounds only for a policy that reads it.
    fields += ["prompt"] if any(p.reads_prompt for p in policies) else []
    rows = with_tiers(facts.select(*dict.fromkeys(fields)), tiers)
    names = F.array(*[F.lit(p.name) for p in policies])
    pending = materialize(rows.withColumn("policy", F.explode(names)), "ledger-rows")
    state = pending.groupBy(*keys).agg(
        F.first("budget").cast(COST_SUM).alias("balance"), (F.min("ord") - 1).alias("pos")
    )
    shown = ["tier_pos", "weight", "budget", "domain", *extra]
    out = settle(pending, state, keys, policies, shown)
    cols = per_query_columns(F.col("models"), F.col("_d"), F.col("_r"))
    out = out.withColumn("decision", F.col("_d")).withColumn("predicted_nano", F.lit(None).cast("bigint"))
    return out.withColumns(cols).select(*RESULT_COLUMNS, *extra)
