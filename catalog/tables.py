"""Record tables and table questions."""

from pyspark.sql import functions as F

from askgrid.functions import tables as TB
from askgrid.functions.binding import let
from askgrid.functions.questions import question
from askgrid.operators import tables as OT
from askgrid.sources import fixtures as X
from catalog.base import ANSWERS, LINES


def parsed(spark, sf):
    # Every seventh order's text is cut short, as malformed JSON.
    data = F.when(F.col("l_orderkey") % 7 == 0, F.expr("left(data, length(data) - 1)")).otherwise(F.col("data"))
    rows = X.order_tables(spark, sf).withColumn("data", data).select("sample_id", TB.typed_table(F.col("data")).alias("t"))
    return rows.select(
        "sample_id",
        F.when(F.col("t.status") == "ok", F.size("t.names")).alias("columns"),
        F.when(F.col("t.status") == "ok", F.size("t.rows")).alias("rows"), "t.status",
    )


def inferred(spark, sf):
    tables = X.order_tables(spark, sf)
    types = let(TB.parse_table(F.col("data")), lambda t: TB.infer_types(t["header"], t["rows"]))
    return tables.select("sample_id", F.array_join(types, ",").alias("types"))


def header_names(spark, sf):
    orders = X.read(spark, sf, "orders")
    header = F.array(
        F.col("o_orderstatus"), F.date_format("o_orderdate", "yyyy"), F.lit("P"), F.col("o_orderstatus"), F.lit("O")
    )
    return orders.select("o_orderkey", F.array_join(let(header, TB.column_names), ",").alias("names"))


def coerced(spark, sf):
    typed = '"types":["real","text","real","real"]'
    all_real = '"types":["real","real","real","real"]'
    data = F.when(F.col("l_orderkey") % 6 == 0, F.replace("data", F.lit(typed), F.lit(all_real))).otherwise(F.col("data"))
    tables = X.order_tables(spark, sf).withColumn("data", data)
    t = F.col("t")
    prices = F.transform(t["numbers"], lambda r: F.get(r, F.lit(3)))
    total = F.aggregate(prices, F.lit(0.0), lambda acc, v: acc + v)
    return tables.select("sample_id", TB.typed_table(F.col("data")).alias("t")).select(
        "sample_id", "t.status", F.when(t["status"] == "ok", F.round(total, 2)).alias("total")
    )


def cells(spark, sf):
    return OT.cells(X.order_tables(spark, sf), ["sample_id"])


def rows_again(spark, sf):
    back = OT.rows_from_cells(cells(spark, sf), ["sample_id"])
    c = F.col("cells")
    return back.select("sample_id", "row", c["line"].alias("line"), c["flag"].alias("flag"), c["quantity"].alias("quantity"), c["price"].alias("price"))


SQL_TEXT = """SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity,
  max(l_extendedprice) AS top_price FROM data_table WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus"""


def sql_text(spark, sf):
    return OT.run_sql(X.read(spark, sf, "lineitem"), SQL_TEXT)


def asked(spark, sf, q):
    return OT.answer_questions(X.order_tables(spark, sf).withColumn("question", q))


BOTH = [("flag", "=", "R"), ("Quantity", ">", "25")]


def picked(spark, sf):
    rows = asked(spark, sf, question("line", conds=BOTH))
    return rows.select("sample_id", F.posexplode("answer.picks").alias("nth", "pick"))


def aggregated(spark, sf):
    return asked(spark, sf, X.order_question()).select("sample_id", "answer.value")


def grouped(spark, sf):
    rows = X.order_tables(spark, sf).withColumn("question", question("quantity", "SUM", group_col="flag"))
    return OT.answer_grouped(rows, ["sample_id"]).select("sample_id", "group_value", "value", "result")


def first_group(spark, sf):
    rows = X.order_tables(spark, sf).withColumn("question", question("quantity", "COUNT", group_col="flag"))
    return OT.first_group(OT.answer_grouped(rows, ["sample_id"]), ["sample_id"])


def top_one(spark, sf):
    q = question("line", order_col="quantity", descending=True, limit=1)
    return asked(spark, sf, q).select("sample_id", "answer.result")


def top_three(spark, sf):
    q = question("line", order_col="quantity", descending=True, limit=3)
    return asked(spark, sf, q).select("sample_id", F.array_join("answer.picks", ",").alias("lines"))


def distinct_values(spark, sf):
    rows = asked(spark, sf, question("flag", is_distinct=True))
    return rows.select("sample_id", F.array_join(F.array_sort("answer.picks"), ",").alias("flags"))


def distinct_count(spark, sf):
    return asked(spark, sf, question("flag", "COUNT", is_distinct=True)).select("sample_id", "answer.result")


def scalar(spark, sf):
    return OT.answer_text(asked(spark, sf, X.order_question())).select("sample_id", "pred")


def failed(spark, sf):
    col = F.when(F.col("l_orderkey") % 4 == 0, F.lit("colour")).otherwise(F.lit("flag"))
    rows = OT.answer_text(asked(spark, sf, question(col, "MAX")))
    return rows.select("sample_id", "answer.status", "pred")


W = f"WITH {LINES}"
ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(qty AS VARCHAR)"
ROW = f"row_number() OVER (PARTITION BY sample_id {ORDER}) - 1"
TYPES = "CASE WHEN l_orderkey % 2 = 0 THEN '{0}' ELSE '{1}' END"
TEXT_CELLS = "format('{:,.2f}', l_extendedprice)"
YEAR = "strftime(o_orderdate, '%Y') || '_'"

QUERIES = {
    "g1_parse_table": (
        parsed,
        f"""{W} SELECT sample_id, CASE WHEN l_orderkey % 7 <> 0 THEN 4 END AS columns, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(count(*) AS INT) END AS rows,
            CASE WHEN l_orderkey % 7 = 0 THEN 'bad_json' ELSE 'ok' END AS status FROM lines GROUP BY sample_id, l_orderkey"""),
    "g2_infer_types": (
        inferred,
        f"{W} SELECT DISTINCT sample_id, 'real,text,real,text' AS types FROM lines"),
    "g3_column_names": (
        header_names,
        f"""SELECT o_orderkey, o_orderstatus || ',' || {YEAR} || ',' ||
              CASE o_orderstatus WHEN 'P' THEN 'P.1' ELSE 'P' END || ',' || o_orderstatus || CASE o_orderstatus WHEN 'P' THEN '.2' ELSE '.1' END
              || ',' || CASE o_orderstatus WHEN 'O' THEN 'O.2' ELSE 'O' END AS names FROM orders"""),
    "g4_coerce_numbers": (
        coerced,
        f"""{W} SELECT sample_id, CASE WHEN l_orderkey % 6 = 0 THEN 'bad_number' ELSE 'ok' END AS status,
            CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 6 <> 0 THEN round(sum(l_extendedprice), 2) END AS total
            FROM lines GROUP BY sample_id, l_orderkey"""),
    "g5_cells": (
        cells,
        f"""{W}, numbered AS (SELECT *, CAST({ROW} AS INT) AS row FROM lines)
            SELECT sample_id, row, 0 AS column, 'line' AS name, 'real' AS type, CAST(l_linenumber AS VARCHAR) AS value, CAST(l_linenumber AS DOUBLE) AS number FROM numbered
            UNION ALL SELECT sample_id, row, 1, 'flag', 'text', l_returnflag, NULL FROM numbered
            UNION ALL SELECT sample_id, row, 2, 'quantity', 'real', CAST(qty AS VARCHAR), l_quantity FROM numbered
            UNION ALL SELECT sample_id, row, 3, 'price', {TYPES.format('real', 'text')}, {TEXT_CELLS},
              CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice END FROM numbered"""),
    "g5_rows_from_cells": (
        rows_again,
        f"""{W} SELECT sample_id, CAST({ROW} AS INT) AS row, CAST(l_linenumber AS VARCHAR) AS line, l_returnflag AS flag,
            CAST(qty AS VARCHAR) AS quantity, {TEXT_CELLS} AS price FROM lines"""),
    "g6_sql_text": (sql_text, SQL_TEXT.replace("data_table", "lineitem")),
    "g7_pick_where": (
        picked,
        f"""{W} SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id {ORDER}) - 1 AS INT) AS nth,
            l_linenumber || '.0' AS pick FROM lines WHERE l_returnflag = 'R' AND l_quantity > 25"""),
    "g8_aggregates": (aggregated, f"{W}, {ANSWERS} SELECT sample_id, value FROM answers"),
    "g9_grouped": (
        grouped,
        f"""{W} SELECT sample_id, l_returnflag AS group_value, sum(l_quantity) AS value,
            CAST(sum(l_quantity) AS VARCHAR) AS result FROM lines GROUP BY sample_id, l_returnflag"""),
    "g9_first_group": (
        first_group,
        f"""{W} SELECT sample_id, arg_min(result, l_returnflag) AS result FROM (
            SELECT sample_id, l_returnflag, CAST(count(*) AS VARCHAR) AS result FROM lines GROUP BY ALL) GROUP BY sample_id"""),
    "g10_top_one": (
        top_one,
        f"""{W} SELECT sample_id, l_linenumber || '.0' AS result FROM (
            SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lines) WHERE place = 1"""),
    "g10_top_three": (
        top_three,
        f"""{W} SELECT sample_id, string_agg(l_linenumber || '.0', ',' ORDER BY place) AS lines FROM (
            SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lines)
            WHERE place <= 3 GROUP BY sample_id"""),
    "g11_distinct": (
        distinct_values,
        f"{W} SELECT sample_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lines GROUP BY sample_id"),
    "g11_count_distinct": (
        distinct_count,
        f"{W} SELECT sample_id, CAST(count(DISTINCT l_returnflag) AS VARCHAR) AS result FROM lines GROUP BY sample_id"),
    "g12_scalar_answer": (scalar, f"{W}, {ANSWERS} SELECT sample_id, result AS pred FROM answers"),
    "g13_bad_question": (
        failed,
        f"""{W} SELECT sample_id, CASE WHEN l_orderkey % 4 = 0 THEN 'no_such_column' ELSE 'ok' END AS status,
            CASE WHEN l_orderkey % 4 = 0 THEN 'SQL is malformed: SELECT MAX(colour) FROM data_table' || chr(10) || 'Exception:no_such_column'
                 ELSE max(l_returnflag) END AS pred FROM lines GROUP BY sample_id, l_orderkey"""),
}
