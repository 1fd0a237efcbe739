"""What every job must know about a log before it starts, from one aggregate."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.schema import MAX_DOMAINS, MAX_MODELS_PER_EXAMPLE


@dataclass(frozen=True)
class Profile:
    """Domains with row counts, the catalogue, and whether quotes are the same everywhere."""

    counts: dict[str, int]
    model_ids: list[str]
    quotes: dict[str, Decimal] | None

    @property
    def domains(self) -> list[str]:
        return sorted(self.counts)

    def roles(self) -> tuple[str, str]:
        """Cheapest and dearest model of a stable catalogue."""

        if self.quotes is None:
            raise ValueError("models and quotes must be the same in every example")
        pairs = [(q, m) for m, q in self.quotes.items()]
        return min(pairs)[1], max(pairs)[1]


def profile(log: DataFrame) -> Profile:
    """One pass over domain and models; at most domains x models rows come back.

    Fails unless every example has the same models, sorted by ID.
    """

    limit = MAX_DOMAINS * MAX_MODELS_PER_EXAMPLE
    rows = (
        log.select("domain", F.posexplode("models").alias("pos", "m"))
        .groupBy("domain", F.col("m.model_id").alias("model_id"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"),
            F.min("m.quoted").alias("low"), F.max("m.quoted").alias("high"),
        )
        .limit(limit + 1)
        .collect()
    )
    if not rows:
        raise ValueError("the log has no rows")
    models = sorted({r["model_id"] for r in rows})
    counts = {r["domain"]: r["n"] for r in rows}
    if len(rows) > limit or len(counts) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains or {MAX_MODELS_PER_EXAMPLE} models")
    place = {m: k for k, m in enumerate(models)}
    aligned = len(rows) == len(models) * len(counts) and all(
        r["n"] == counts[r["domain"]] and r["first"] == r["last"] == place[r["model_id"]] for r in rows
    )
    if not aligned:
        raise ValueError("every example needs the same models, sorted by ID")
    seen: dict[str, set[Decimal]] = {}
    for r in rows:
        seen.setdefault(r["model_id"], set()).update((r["low"], r["high"]))
    stable = all(len(v) == 1 for v in seen.values())
    return Profile(counts, models, {m: min(v) for m, v in seen.items()} if stable else None)
