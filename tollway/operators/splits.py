"""Splits of a wide log into calibration and evaluation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Calibration and evaluation members of every domain (counts in the balanced
# split, parts of the whole in the share split), and the share that a prefix split calibrates on.
CALIBRATION_PER_DOMAIN = 64
EVALUATION_PER_DOMAIN = 8
PREFIX_ONE_IN = 5


def share_split(
    rows: DataFrame,
    revision: str,
    calibrate: int = CALIBRATION_PER_DOMAIN,
    evaluate: int = EVALUATION_PER_DOMAIN,
) -> DataFrame:
    """Every row by a hash of (revision, domain, id): ``calibrate`` parts to ``evaluate`` parts.

    Outcomes, costs and texts play no part, each domain is split in the same proportion, and
    no row is left out.  One expression per row, without a shuffle.
    """

    if calibrate < 1 or evaluate < 1:
        raise ValueError("both sides need a share")
    sep = F.lit("\x1f")
    digest = F.sha2(F.concat(F.lit(revision), sep, F.coalesce("domain", F.lit("")), sep, "example_id"), 256)
    end = F.lit(f"{16**15 * calibrate // (calibrate + evaluate):015x}")
    side = F.when(F.substring(digest, 1, 15) < end, "calibration").otherwise("evaluation")
    return rows.withColumn("role", side)


def balanced_split(
    rows: DataFrame,
    revision: str,
    calibrate: int = CALIBRATION_PER_DOMAIN,
    evaluate: int = EVALUATION_PER_DOMAIN,
    salts: int = 64,
) -> DataFrame:
    """Per domain the first rows by a hash of (revision, domain, id): calibration, then evaluation.

    Outcomes, costs and texts play no part in the ranking.  A domain may hold most of the
    rows, so each of its hash slices is cut to the needed count first; the second
    ranking sees at most ``salts`` times that count.
    """

    keep = calibrate + evaluate
    sep = F.lit("\x1f")
    ranked = rows.withColumn("_rank", F.sha2(F.concat(F.lit(revision), sep, "domain", sep, "example_id"), 256))
    ranked = ranked.withColumn("_salt", F.pmod(F.hash("_rank"), F.lit(salts)))
    first = Window.partitionBy("domain", "_salt").orderBy("_rank", "ord")
    short = ranked.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= keep)
    final = Window.partitionBy("domain").orderBy("_rank", "ord")
    top = short.withColumn("_rn", F.row_number().over(final)).where(F.col("_rn") <= keep)
    role = F.when(F.col("_rn") <= calibrate, "calibration").otherwise("evaluation")
    return top.withColumn("role", role).withColumn("rank", F.col("_rn")).drop("_rank", "_salt", "_rn")


def prefix_split(rows: DataFrame, one_in: int = PREFIX_ONE_IN) -> DataFrame:
    """The whole log in source order: the first part in ``one_in`` calibrates, the rest evaluates."""

    from tollway.operators.prefix import running_totals

    numbered = running_totals(rows, [], "ord", {"_rn": F.lit(1).cast("bigint")})
    n = rows.count()
    role = F.when(F.col("_rn") <= max(1, n // one_in), "calibration").otherwise("evaluation")
    return numbered.withColumn("role", role).drop("_rn")


def surrogate_ids(rows: DataFrame, prefix: str, width: int = 4) -> DataFrame:
    """Replaces private IDs by zero-padded numbers in source order."""

    from tollway.operators.prefix import running_totals

    numbered = running_totals(rows, [], "ord", {"_n": F.lit(1).cast("bigint")})
    name = F.format_string(f"{prefix}%0{width}d", F.col("_n") - 1)
    return numbered.withColumn("example_id", name).drop("_n")


def domain_counts(rows: DataFrame) -> DataFrame:
    """Rows per domain; the null domain is out of scope."""

    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "in_scope", F.col("domain").isNotNull()
    )
