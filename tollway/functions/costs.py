"""Exact cost text and arithmetic on DECIMAL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollway.schema import COST, COST_SUM

# Fixed value: the accepted cost syntax.
COST_TEXT = r"^[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?)|(?:\.[0-9]+))(?:[eE][+-]?[0-9]+)?$"


def parse_cost(text: Column) -> Column:
    """Null unless the text is a plain decimal number that fits; sign is checked apart."""

    return F.when(text.rlike(COST_TEXT), text.try_cast(COST))


def cost_text(cost: Column) -> Column:
    """Shortest plain text: no exponent, no trailing zeros."""

    plain = cost.cast("string")
    trimmed = F.regexp_replace(plain, r"\.?0+$", "")
    text = F.when(F.instr(plain, ".") > 0, trimmed).otherwise(plain)
    return F.when(cost == 0, F.lit("0")).otherwise(text)


def add_cost(left: Column, right: Column) -> Column:
    return (left + right).cast(COST)


def subtract_cost(left: Column, right: Column) -> Column:
    """Fails when the difference would be negative."""

    return F.when(right > left, F.raise_error(F.lit("cost difference is negative"))).otherwise(
        (left - right).cast(COST)
    )


def scale_cost(cost: Column, count: Column) -> Column:
    return (cost * count.cast("decimal(10,0)")).cast(COST_SUM)


def divide_cost(cost: Column, count: Column) -> Column:
    """Quotient at the scale of the cost type, rounded half up."""

    return (cost.cast(COST_SUM) / count.cast("decimal(19,0)")).cast(COST)


def micro(cost: Column) -> Column:
    """Millionths as a whole number, for reports that other engines check."""

    return F.round(cost * 1000000, 0).cast("bigint")
