"""Record tables and questions over whole DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions import questions as Q
from askgrid.functions import tables as TB
from askgrid.functions.binding import let


def with_table(df: DataFrame, data: str = "data", name: str = "table") -> DataFrame:
    """Add the typed table of each record."""
    return df.withColumn(name, TB.typed_table(F.col(data)))


def cells(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Long form: one row per cell. No shuffle; bad tables give no cells."""
    rows = (
        df.select(*keys, TB.typed_table(F.col(data)).alias("t"))
        .where(F.col("t.status") == "ok")
        .select(
            *keys, F.col("t.names").alias("names"), F.col("t.types").alias("types"),
            F.posexplode(F.arrays_zip("t.rows", "t.numbers")).alias("row", "cells"),
        )
    )
    return rows.select(
        *keys, "row",
        F.posexplode(
            F.transform(
                "names",
                lambda n, i: F.struct(
                    n.alias("name"),
                    F.get("types", i).alias("type"),
                    F.get(F.col("cells.rows"), i).alias("value"),
                    F.get(F.col("cells.numbers"), i).alias("number"),
                ),
            )
        ).alias("column", "cell"),
    ).select(*keys, "row", "column", "cell.*")


def rows_from_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Back to one map per table row; a group is as wide as one table row."""
    return df.groupBy(*keys, "row").agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("column", "name", "value"))),
                lambda c: F.struct(c["name"], c["value"]),
            )
        ).alias("cells")
    )


def answer_questions(
    df: DataFrame, data: str = "data", question: str = "question", name: str = "answer"
) -> DataFrame:
    """Answer each record's question on its own table, inside the row."""
    return df.withColumn(name, Q.answer(F.col(data), F.col(question)))


def failure_text(q: Column, status: Column, asked: Column | None = None) -> Column:
    asked = Q.question_text(q) if asked is None else asked
    return F.concat(
        F.lit("SQL is malformed: "), F.coalesce(asked, F.lit("")), F.lit("\nException:"), status
    )


def answer_text(
    df: DataFrame, question: str = "question", answer: str = "answer",
    asked: str | None = None, name: str = "pred",
) -> DataFrame:
    """The answer as text, or a message with the question when it failed."""
    a = F.col(answer)
    message = failure_text(F.col(question), a["status"], F.col(asked) if asked else None)
    return df.withColumn(name, F.when(a["status"] == "ok", a["result"]).otherwise(message))


def answer_grouped(
    df: DataFrame, keys: list[str], data: str = "data", question: str = "question"
) -> DataFrame:
    """One row per record and group value.

    Rows are filtered inside the record first, so only two cells per matching row
    reach the shuffle, and partial aggregation runs before it.
    """
    q = F.col(question)

    def picked(t: Column) -> Column:
        return let(Q.resolve(t, q), lambda r: of_rows(t, r))

    def of_rows(t: Column, r: Column) -> Column:
        good = (Q.question_status(t, q, r) == "ok") & r["group"].isNotNull()
        return F.when(
            good,
            F.transform(
                Q.matching_rows(t, r),
                lambda i: F.struct(
                    Q.cell(t, i, r["group"]).alias("key"),
                    Q.cell(t, i, r["pick"]).alias("cell"),
                ),
            ),
        )

    rows = df.select(
        *keys, F.upper(q["agg"]).alias("agg"),
        F.coalesce(q["pick"], F.lit("*")).alias("pick"),
        F.explode(let(TB.typed_table(F.col(data)), picked)).alias("p"),
    )
    return grouped_values(rows, keys)


def grouped_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sum up ``(keys, agg, pick, p(key, cell))`` by record and group value; ``pick`` is ``*`` for all columns."""
    cell = F.col("p.cell")
    known = cell["num"].isNotNull() | cell["txt"].isNotNull()
    number = F.when(known, F.coalesce(cell["num"], Q.leading_number(cell["txt"])))
    grouped = rows.groupBy(*keys, "agg", "pick", F.col("p.key").alias("key")).agg(
        F.sum(number).alias("total"),
        F.count(F.when(known, 1)).alias("known"),
        F.count(F.lit(1)).alias("hits"),
        F.max(F.when(known, cell)).alias("high"),
        F.min(F.when(known, cell)).alias("low"),
    )
    counted = F.when(F.col("pick") == "*", F.col("hits")).otherwise(F.col("known"))
    value = (
        F.when(F.col("agg") == "COUNT", counted.cast("double"))
        .when(F.col("agg") == "SUM", F.col("total"))
        .when(F.col("agg") == "AVG", F.try_divide(F.col("total"), F.col("known")))
        .when(F.col("agg") == "MAX", F.col("high.num"))
        .otherwise(F.col("low.num"))
    )
    text = (
        F.when(F.col("agg") == "COUNT", counted.cast("string"))
        .when(F.col("agg") == "MAX", Q.cell_text(F.col("high")))
        .when(F.col("agg").isin("SUM", "AVG"), Q.float_text(value))
        .otherwise(Q.cell_text(F.col("low")))
    )
    return grouped.select(
        *keys, Q.cell_text(F.col("key")).alias("group_value"), F.col("key").alias("group_key"),
        value.alias("value"), F.coalesce(text, F.lit("None")).alias("result"),
    )


def first_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """The scalar answer of a grouped question: its lowest group's value."""
    return df.groupBy(*keys).agg(F.min_by("result", "group_key").alias("result"))


def ask_sql(df: DataFrame, text: str) -> str:
    """Run Spark SQL over one large table named ``data_table``; first cell as text."""
    rows = run_sql(df, text).take(1)
    return "None" if not rows or rows[0][0] is None else str(rows[0][0])


def run_sql(df: DataFrame, text: str) -> DataFrame:
    """Run Spark SQL over one large table named ``data_table``.

    The name holds inside this query alone, so calls in one session never meet, and a view of
    that name in the session stays as it is.
    """
    body = text.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql("WITH data_table AS (SELECT * FROM {asked_rows}) SELECT * FROM (\n" + body + "\n)", asked_rows=df)
