"""Numbers as the reference's scripting language rounds and prints them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askgrid.functions.binding import let

# 2^27 + 1 splits a double into two halves; above 2^46 neighbouring
# doubles are more than 0.01 apart, so rounding to two places changes nothing.
SPLITTER = 134217729.0
WHOLE_FROM = 70368744177664.0


def round2(x: Column) -> Column:
    """Round to two places by the exact binary value, ties to even.

    ``round`` would decide by the shortest decimal text and turn 2.675 into 2.68.
    Here ``100 * x`` is kept exactly as the sum of two doubles, so the comparison
    with the half-way point has no rounding error.
    """

    def nearest(v: Column) -> Column:
        high = v * SPLITTER - (v * SPLITTER - v)
        low = v - high
        below = F.floor(v * 100.0).cast("double")
        over_half = ((high * 100.0 - below) - 0.5) + low * 100.0
        up = (over_half > 0) | ((over_half == 0) & (below % 2 != 0))
        cents = F.when(up, below + 1.0).otherwise(below)
        return (
            F.when(F.isnan(v) | (v == 0) | (F.abs(v) >= WHOLE_FROM), v)
            .when((v < 0) & (cents == 0), F.lit(-0.0))
            .otherwise(cents / 100.0)
        )

    return nearest(x)


def _respelled(text: Column) -> Column:
    """Text of a double that Spark writes with ``E``, as ``NaN`` or as ``Infinity``."""

    def plain(scale: int) -> Column:
        digits = F.rtrim(text.cast(f"decimal(38,{scale})").cast("string"), F.lit("0"))
        return F.regexp_replace(digits, r"\.$", ".0")

    power = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    digits = F.abs(power).cast("string")
    padded = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    return (
        F.when(power.isNull(), F.replace(F.lower(text), F.lit("infinity"), F.lit("inf")))
        .when((power >= 7) & (power < 16), plain(10))
        .when(power == -4, plain(25))
        .otherwise(F.concat(mantissa, sign, padded))
    )


def float_text(x: Column) -> Column:
    """Shortest text of a double: ``5.0``, ``12345678.9``, ``1e+16``, ``inf``."""
    text = x.cast("string")
    usual = ~(F.contains(text, F.lit("E")) | F.contains(text, F.lit("N")) | F.contains(text, F.lit("I")))
    return F.when(usual, text).otherwise(let(text, _respelled))


def leading_number(text: Column) -> Column:
    """The number a text starts with, else 0 (how sums read text columns)."""
    found = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def bound_text(x: Column) -> Column:
    """:func:`float_text` of an expression that is costly to repeat."""
    return let(x, float_text)
