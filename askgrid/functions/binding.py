"""Bind an expression to a name inside one row expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain ``withColumn`` does not give that guarantee: the optimizer inlines a
    column that is named once, even if that one place is a lambda that runs per
    array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections refer to, never repeat.

    The optimizer copies a plain column's expression into every filter above it; an
    expression used many times there multiplies the plan. It does not look into a
    one-element ``explode``.
    """
    return df.withColumn(name, F.explode(F.array(value)))
