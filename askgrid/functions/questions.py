"""Table questions as data: pick a column, keep matching rows, summarise.

A question is a struct (see ``schemas.QUESTION``), so a column of questions is
answered by one expression over a column of tables, row by row and without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askgrid.functions.binding import let
from askgrid.functions.numbers import float_text, leading_number
from askgrid.schemas import QUESTION

# The aggregates and comparison signs a question may use.
AGGREGATES = ["MAX", "MIN", "COUNT", "SUM", "AVG"]
SIGNS = ["=", "==", "<>", "!=", ">", "<", ">=", "<=", "LIKE"]

PLAIN_NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def question(
    pick: Column | str | None = None,
    agg: Column | str | None = None,
    conds: list[tuple] | Column | None = None,
    group_col: str | None = None,
    order_col: str | None = None,
    descending: bool = False,
    is_distinct: bool = False,
    limit: int | None = None,
) -> Column:
    """Build a question column; strings are taken as constants."""

    def const(v):
        return v if isinstance(v, Column) else F.lit(v)

    if conds is None or isinstance(conds, list):
        items = [
            F.struct(const(c).alias("col"), const(o).alias("op"), const(v).cast("string").alias("val"))
            for c, o, v in (conds or [])
        ]
        conds = F.array(*items) if items else F.lit(None)
    return F.struct(
        const(agg).alias("agg"), const(pick).alias("pick"), conds.alias("conds"),
        const(group_col).alias("group_col"), const(order_col).alias("order_col"),
        const(descending).alias("descending"), const(is_distinct).alias("is_distinct"),
        const(limit).cast("int").alias("limit"),
    ).cast(QUESTION)


def parse_question(text: Column) -> Column:
    """Read a question written as JSON; unreadable text gives null."""
    return let(F.from_json(text, QUESTION), lambda parsed: F.when(parsed["pick"].isNotNull() | parsed["agg"].isNotNull(), parsed))


def question_text(q: Column) -> Column:
    """The SQL wording of a question, for messages and prompts."""
    conds = F.array_join(
        F.transform(q["conds"], lambda c: F.concat(c["col"], F.lit(" "), c["op"], F.lit(" '"), c["val"], F.lit("'"))),
        " AND ",
    )
    pick = F.coalesce(q["pick"], F.lit("*"))
    pick = F.when(q["is_distinct"], F.concat(F.lit("DISTINCT "), pick)).otherwise(pick)
    target = F.when(q["agg"].isNotNull(), F.concat(q["agg"], F.lit("("), pick, F.lit(")"))).otherwise(pick)
    return F.concat_ws(
        " ",
        F.lit("SELECT"), target, F.lit("FROM data_table"),
        F.when(F.size(q["conds"]) > 0, F.concat(F.lit("WHERE "), conds)),
        F.concat(F.lit("GROUP BY "), q["group_col"]),
        F.concat(F.lit("ORDER BY "), q["order_col"]),
        F.when(q["descending"], F.lit("DESC")),
        F.concat(F.lit("LIMIT "), q["limit"].cast("string")),
    )


def _known(number: Column) -> Column:
    """NaN cells count as missing."""
    return F.when(~F.isnan(number), number)


def _compare(op: Column, left: Column, right: Column) -> Column:
    return (
        F.when(op.isin("=", "=="), left == right)
        .when(op.isin("<>", "!="), left != right)
        .when(op == ">", left > right)
        .when(op == "<", left < right)
        .when(op == ">=", left >= right)
        .when(op == "<=", left <= right)
    )


def _like(cell: Column, pattern: Column) -> Column:
    return F.ilike(cell, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


def holds(cond: Column, number: Column, text: Column) -> Column:
    """One condition (its ``op``, ``val``, ``num`` and ``real``) on one cell; the column's type decides how to compare."""
    # A text literal sorts after every number.
    against_text = cond["op"].isin("<", "<=", "<>", "!=")
    real = (
        F.when(cond["op"] == "LIKE", _like(float_text(number), cond["val"]))
        .when(cond["num"].isNotNull(), _compare(cond["op"], number, cond["num"]))
        .otherwise(against_text & cond["val"].isNotNull())
    )
    words = F.when(cond["op"] == "LIKE", _like(text, cond["val"])).otherwise(
        _compare(cond["op"], text, cond["val"])
    )
    cell_missing = F.when(cond["real"], number.isNull()).otherwise(text.isNull())
    return F.when(cell_missing, F.lit(False)).otherwise(
        F.coalesce(F.when(cond["real"], real).otherwise(words), F.lit(False))
    )


def resolve(table: Column, q: Column) -> Column:
    """Turn the question's column names into positions in this table (0-based)."""
    lower_names = F.transform(table["names"], F.lower)

    def body(names: Column) -> Column:
        def place(name: Column) -> Column:
            found = F.array_position(names, F.lower(name)).cast("int")
            return F.when(name.isNotNull(), found - 1)

        conds = F.transform(
            F.coalesce(q["conds"], F.array().cast(QUESTION["conds"].dataType)),
            lambda c: F.struct(
                place(c["col"]).alias("ix"),
                F.upper(c["op"]).alias("op"),
                c["val"].alias("val"),
                F.when(F.rlike(c["val"], F.lit(PLAIN_NUMBER)), F.btrim(c["val"]).try_cast("double")).alias("num"),
                (F.get(table["types"], place(c["col"])) == "real").alias("real"),
            ),
        )
        star = F.coalesce(q["pick"], F.lit("*")) == "*"
        pick = F.when(star, F.lit(None).cast("int")).otherwise(place(q["pick"]))
        return F.struct(
            conds.alias("conds"),
            pick.alias("pick"),
            place(q["group_col"]).alias("group"),
            place(q["order_col"]).alias("order"),
            F.upper(q["agg"]).alias("agg"),
        )

    return let(lower_names, body)


def question_status(table: Column, q: Column, r: Column) -> Column:
    """Why a question cannot be answered, or ``ok``."""
    unknown = (
        F.exists(r["conds"], lambda c: F.coalesce(c["ix"], F.lit(-1)) < 0)
        | (F.coalesce(r["pick"], F.lit(0)) < 0)
        | (F.coalesce(r["group"], F.lit(0)) < 0)
        | (F.coalesce(r["order"], F.lit(0)) < 0)
    )
    malformed = (
        F.coalesce(~r["agg"].isin(AGGREGATES), F.lit(False))
        | F.exists(r["conds"], lambda c: ~F.coalesce(c["op"].isin(SIGNS), F.lit(False)))
        | (r["pick"].isNull() & F.coalesce(r["agg"] != "COUNT", F.lit(True)))
    )
    return (
        F.when(q.isNull(), F.lit("bad_question"))
        .when(table["status"] != "ok", table["status"])
        .when(unknown, F.lit("no_such_column"))
        .when(malformed, F.lit("bad_question"))
        .otherwise(F.lit("ok"))
    )


def matching_rows(table: Column, r: Column) -> Column:
    """Positions of the rows that satisfy every condition, in table order."""
    places = F.transform(table["rows"], lambda _, i: i)

    def keeps(i: Column) -> Column:
        return F.forall(
            r["conds"],
            lambda c: holds(
                c,
                _known(F.get(F.get(table["numbers"], i), c["ix"])),
                F.get(F.get(table["rows"], i), c["ix"]),
            ),
        )

    return F.filter(places, keeps)


def cell(table: Column, row: Column, place: Column) -> Column:
    """``struct(num, txt)`` of a cell; exactly one of the two is used."""
    number = _known(F.get(F.get(table["numbers"], row), place))
    real = F.get(table["types"], place) == "real"
    return F.struct(
        number.alias("num"),
        F.when(~real, F.get(F.get(table["rows"], row), place)).alias("txt"),
    )


def cell_text(c: Column) -> Column:
    return F.coalesce(float_text(c["num"]), c["txt"])


def _ordered(table: Column, q: Column, r: Column, hits: Column) -> Column:
    """Row positions in the asked order; missing values sort lowest, ties keep table order."""

    def keyed(sign: int) -> Column:
        def key(i: Column) -> Column:
            return let(
                cell(table, i, r["order"]),
                lambda c: F.struct(
                    (c["num"].isNotNull() | c["txt"].isNotNull()).alias("known"),
                    c["num"].alias("num"), c["txt"].alias("txt"), (i * sign).alias("at"),
                ),
            )

        return F.transform(hits, key)

    def places(pairs: Column) -> Column:
        return F.transform(pairs, lambda s: F.abs(s["at"]))

    top = F.coalesce(q["limit"], F.lit(0)) == 1
    down = F.when(top, F.array(F.array_max(keyed(-1)))).otherwise(F.sort_array(keyed(-1), asc=False))
    up = F.when(top, F.array(F.array_min(keyed(1)))).otherwise(F.sort_array(keyed(1)))
    return F.when((F.size(hits) == 0) | r["order"].isNull(), hits).otherwise(
        places(F.when(q["descending"], down).otherwise(up))
    )


def _aggregate(agg: Column, cells: Column, hit_count: Column, star: Column) -> Column:
    """``struct(num, txt)`` of an aggregate over the picked cells."""
    known = F.filter(cells, lambda c: c["num"].isNotNull() | c["txt"].isNotNull())

    def body(cs: Column) -> Column:
        total = F.aggregate(
            cs, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["num"], leading_number(c["txt"]))
        )
        count = F.size(cs)
        whole = F.forall(cs, lambda c: F.coalesce(F.rlike(c["txt"], F.lit(r"^\s*[-+]?\d+\s*$")), F.lit(False)))
        count_value = F.when(star, hit_count).otherwise(count)
        # Spark orders structs field by field, and only one of the two fields is set.
        extreme = F.when(agg == "MAX", F.array_max(cs)).otherwise(F.array_min(cs))
        summary = (
            F.when(agg == "COUNT", F.struct(count_value.cast("double").alias("num"), count_value.cast("string").alias("txt")))
            .when(count == 0, F.lit(None))
            .when(
                agg == "SUM",
                let(total, lambda t: F.struct(
                    t.alias("num"),
                    F.when(whole, t.cast("decimal(38,0)").cast("string")).otherwise(float_text(t)).alias("txt"),
                )),
            )
            .when(agg == "AVG", let(total / count, lambda t: F.struct(t.alias("num"), float_text(t).alias("txt"))))
            .otherwise(let(extreme, lambda e: F.struct(e["num"].alias("num"), cell_text(e).alias("txt"))))
        )
        return summary

    return let(known, body)


def answer(data: Column, q: Column) -> Column:
    """``struct(result, value, picks, status)`` for one question on one table.

    ``result`` is the first cell of the first result row as text, ``"None"`` when
    there is none; ``picks`` lists the whole result column of a question without
    aggregate.
    """
    from askgrid.functions.tables import typed_table

    def on_table(t: Column) -> Column:
        return let(resolve(t, q), lambda r: on_resolved(t, r))

    def on_resolved(t: Column, r: Column) -> Column:
        return let(question_status(t, q, r), lambda s: F.when(s == "ok", on_hits(t, r)).otherwise(failed(s)))

    def failed(status: Column) -> Column:
        return packed(F.lit(None).cast("string"), F.lit(None).cast("double"),
                      F.lit(None).cast(T.ArrayType(T.StringType())), status)

    def on_hits(t: Column, r: Column) -> Column:
        return let(matching_rows(t, r), lambda hits: on_ordered(t, r, hits))

    def on_ordered(t: Column, r: Column, hits: Column) -> Column:
        rows = F.when(r["agg"].isNull(), _ordered(t, q, r, hits)).otherwise(hits)
        cells = F.transform(rows, lambda i: cell(t, i, r["pick"]))
        cells = let(cells, lambda cs: F.when(q["is_distinct"], F.array_distinct(cs)).otherwise(cs))
        return let(cells, lambda cs: finish(r, cs, F.size(hits)))

    def finish(r: Column, cells: Column, hit_count: Column) -> Column:
        listed = F.when(q["limit"].isNotNull(), F.slice(cells, F.lit(1), q["limit"])).otherwise(cells)
        plain = let(
            listed,
            lambda cs: packed(
                F.coalesce(cell_text(F.get(cs, F.lit(0))), F.lit("None")),
                F.get(cs, F.lit(0))["num"], F.transform(cs, cell_text), F.lit("ok"),
            ),
        )
        summed = let(
            _aggregate(r["agg"], cells, hit_count, r["pick"].isNull()),
            lambda v: packed(
                F.coalesce(v["txt"], F.lit("None")), v["num"],
                F.lit(None).cast(T.ArrayType(T.StringType())), F.lit("ok"),
            ),
        )
        return F.when(r["agg"].isNull(), plain).otherwise(summed)

    def packed(result: Column, value: Column, picks: Column, status: Column) -> Column:
        return F.struct(
            result.alias("result"), value.alias("value"), picks.alias("picks"), status.alias("status")
        )

    return let(typed_table(data), on_table)
