"""Record tables: a small table carried as JSON text in one column.

All builders work inside the row, so typing, checking and answering a table needs
no shuffle however many records there are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askgrid.functions.binding import let
from askgrid.schemas import RECORD_TABLE

# A name or cell made of numeric characters only; a cell that parses
# as a float (commas already removed).
ALL_NUMERIC = r"^\p{N}+$"
FLOAT_CELL = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def parse_table(data: Column) -> Column:
    return F.from_json(data, RECORD_TABLE)


def to_number(cell: Column) -> Column:
    """Cell text to double after dropping commas; null if it is no number."""
    clean = F.btrim(F.replace(cell, F.lit(","), F.lit("")))
    return F.when(F.rlike(clean, F.lit(FLOAT_CELL)), clean.try_cast("double"))


def infer_types(header: Column, rows: Column) -> Column:
    """``real`` where every cell of a column is numeric characters only, else ``text``."""

    def of_column(_: Column, i: Column) -> Column:
        numeric = F.forall(
            rows, lambda r: F.coalesce(F.rlike(F.get(r, i), F.lit(ALL_NUMERIC)), F.lit(False))
        )
        return F.when(numeric, F.lit("real")).otherwise(F.lit("text"))

    return F.transform(header, of_column)


def column_names(header: Column) -> Column:
    """Repeated names become ``a``, ``a.1``; then all-numeric names get ``_``."""

    def rename(name: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(header, F.lit(1), i), lambda other: other == name))
        unique = F.when(seen > 0, F.concat(name, F.lit("."), seen.cast("string"))).otherwise(name)
        return F.when(
            F.rlike(unique, F.lit(ALL_NUMERIC)), F.concat(unique, F.lit("_"))
        ).otherwise(unique)

    return F.transform(header, rename)


def number_rows(rows: Column, types: Column) -> Column:
    """Numeric twin of ``rows``: doubles in ``real`` columns, null elsewhere."""
    return F.transform(
        rows,
        lambda r: F.transform(
            types, lambda t, i: F.when(t == "real", to_number(F.get(r, i)))
        ),
    )


def _status(table: Column, types: Column, names: Column, numbers: Column) -> Column:
    header, rows = table["header"], table["rows"]
    widest = F.array_max(F.transform(rows, lambda r: F.size(r)))
    no_types = table["types"].isNull()
    lower_names = F.transform(names, F.lower)
    has_gap = F.exists(
        rows, lambda r: (F.size(r) < F.size(header)) | F.exists(r, lambda v: v.isNull())
    )
    bad_number = F.exists(
        numbers,
        lambda n: F.size(F.filter(n, lambda v, i: v.isNull() & (F.get(types, i) == "real"))) > 0,
    )
    return (
        F.when(header.isNull() | rows.isNull(), F.lit("bad_json"))
        .when((F.size(rows) > 0) & (widest != F.size(header)), F.lit("ragged"))
        .when(no_types & has_gap, F.lit("bad_types"))
        .when(~no_types & (F.size(table["types"]) < F.size(header)), F.lit("bad_types"))
        .when(
            F.size(F.array_distinct(lower_names)) < F.size(lower_names), F.lit("duplicate_column")
        )
        .when(bad_number, F.lit("bad_number"))
        .otherwise(F.lit("ok"))
    )


def typed_table(data: Column) -> Column:
    """``struct(names, types, rows, numbers, status)`` of a JSON record table."""

    def with_types(table: Column) -> Column:
        types = F.coalesce(table["types"], infer_types(table["header"], table["rows"]))
        return let(types, lambda ty: with_numbers(table, ty))

    def with_numbers(table: Column, types: Column) -> Column:
        numbers = number_rows(table["rows"], types)
        names = column_names(table["header"])
        return let(
            F.struct(names.alias("names"), numbers.alias("numbers")),
            lambda s: F.struct(
                s["names"].alias("names"),
                types.alias("types"),
                table["rows"].alias("rows"),
                s["numbers"].alias("numbers"),
                _status(table, types, s["names"], s["numbers"]).alias("status"),
            ),
        )

    return let(parse_table(data), with_types)
