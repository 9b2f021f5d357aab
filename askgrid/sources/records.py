"""Pack the rows of a large table into JSON record tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_json(header: list[str], rows: Column, types: Column) -> Column:
    """JSON text of a record table; null ``types`` are left out."""
    return F.to_json(
        F.struct(
            F.array(*[F.lit(h) for h in header]).alias("header"),
            rows.alias("rows"),
            types.alias("types"),
        )
    )


def pack_rows(order: list[str], columns: list[Column]) -> Column:
    """Aggregate: the group's rows as arrays of text, in the given order.

    A record is one value however many rows it has, so that its question gets one answer;
    a table too large for a value is asked with ``run_sql`` instead.
    """
    packed = F.collect_list(F.struct(*order, F.array(*columns).alias("row")))
    return F.transform(F.array_sort(packed), lambda s: s["row"])


def pack_numbers(order: list[str], held: list[str], texts: Callable[[Callable[[str], Column]], list[Column]]) -> Column:
    """As :func:`pack_rows`, of rows whose columns are shorter than their text.

    Rows are gathered with the columns ``order`` and ``held`` as they are and become text behind the shuffle:
    ``texts`` gives the cells, from a function that finds a column by its name.
    """
    packed = F.collect_list(F.struct(*order, *held))
    made = F.transform(packed, lambda s: F.struct(*[s[c].alias(c) for c in order], F.array(*texts(lambda c: s[c])).alias("row")))
    return F.transform(F.array_sort(made), lambda s: s["row"])
