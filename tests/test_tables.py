import json

import pytest
from pyspark.sql import functions as F

from askgrid.functions.questions import parse_question, question
from askgrid.functions.binding import let
from askgrid.functions.tables import infer_types, parse_table, typed_table
from askgrid.operators.tables import answer_grouped, answer_questions, answer_text, ask_sql, cells, first_group

TABLE = {"header": ["a", "2019", "a"], "rows": [["x", "1,234", "7"], ["y", "5", "8"], ["X", "3", "-1"]],
         "types": ["text", "real", "text"]}


def ask(spark, table, **kw):
    text = table if isinstance(table, str) else json.dumps(table)
    df = spark.createDataFrame([(text,)], "data string").withColumn("question", question(**kw))
    return answer_text(answer_questions(df)).select("answer.*", "pred").first()


@pytest.mark.parametrize("kw, pred", [
    (dict(pick="a", conds=[("2019_", ">", "4")]), "x"),
    (dict(pick="2019_", agg="sum"), "1242.0"),
    (dict(pick="A.1", agg="SUM"), "14"),
    (dict(pick="a.1", agg="MAX"), "8"),
    (dict(agg="COUNT", conds=[("a", "LIKE", "x")]), "2"),
    (dict(agg="COUNT", conds=[("a", "=", "x")]), "1"),
    (dict(pick="a", order_col="2019_", descending=True, limit=1), "x"),
    (dict(pick="a", order_col="2019_", limit=1), "X"),
    (dict(pick="a", agg="AVG", conds=[("a", "=", "q")]), "None"),
    (dict(pick="a", agg="COUNT", conds=[("a", "=", "q")]), "0"),
    (dict(pick="a", conds=[("a", "=", "q")]), "None"),
    (dict(pick="a.1", conds=[("a.1", ">", "10")]), "7"),
    (dict(pick="2019_", conds=[("2019_", ">", "abc")]), "None"),
    (dict(pick="2019_", conds=[("2019_", "<", "abc")]), "1234.0"),
])
def test_answers(spark, kw, pred):
    assert ask(spark, TABLE, **kw).pred == pred


def test_lists_and_distinct(spark):
    assert ask(spark, TABLE, pick="a", order_col="2019_", descending=True, limit=2).picks == ["x", "y"]
    table = {"header": ["c"], "rows": [["b"], ["a"], ["b"]], "types": ["text"]}
    assert ask(spark, table, pick="c", is_distinct=True).picks == ["b", "a"]
    assert ask(spark, table, pick="c", agg="COUNT", is_distinct=True).pred == "2"


@pytest.mark.parametrize("table, status", [
    ("{", "bad_json"), ("[1]", "bad_json"), ("", "bad_json"), ('{"header":["a"]}', "bad_json"),
    ({"header": ["a", "b"], "rows": [["1"]], "types": ["text", "text"]}, "ragged"),
    ({"header": ["a"], "rows": [["1"], ["x"]], "types": ["real"]}, "bad_number"),
    ({"header": ["a"], "rows": [["1"], [None]], "types": ["real"]}, "bad_number"),
    ({"header": ["a", "A"], "rows": [], "types": ["text", "text"]}, "duplicate_column"),
    ({"header": ["a", "b"], "rows": [["1", "2"], ["3"]]}, "bad_types"),
    ({"header": ["a"], "rows": [], "types": ["real"]}, "ok"),
])
def test_table_status(spark, table, status):
    text = table if isinstance(table, str) else json.dumps(table)
    df = spark.createDataFrame([(text,)], "data string")
    assert df.select(typed_table(F.col("data"))["status"]).first()[0] == status


def test_types_are_inferred(spark):
    table = {"header": ["p", "q", "r", "t"], "rows": [["5", "-5", "1.5", ""], ["½", "1", "2", "3"]]}
    df = spark.createDataFrame([(json.dumps(table),)], "data string")
    types = let(parse_table(F.col("data")), lambda t: infer_types(t["header"], t["rows"]))
    assert df.select(types).first()[0] == ["real", "text", "text", "text"]


def test_unknown_column(spark):
    got = ask(spark, TABLE, pick="zz")
    assert got.status == "no_such_column"
    assert got.pred == "SQL is malformed: SELECT zz FROM data_table\nException:no_such_column"


def test_cells_and_groups(spark):
    df = spark.createDataFrame([("k", json.dumps(TABLE))], "id string, data string")
    assert cells(df, ["id"]).count() == 9
    asked = df.withColumn("question", question("2019_", "SUM", group_col="a"))
    got = {r.group_value: r.result for r in answer_grouped(asked, ["id"]).collect()}
    assert got == {"x": "1234.0", "y": "5.0", "X": "3.0"}
    assert first_group(answer_grouped(asked, ["id"]), ["id"]).first().result == "3.0"


def test_question_json(spark):
    df = spark.createDataFrame([('{"agg":"SUM","pick":"a"}',), ("no answer",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_question(F.col("t"))).collect()]
    assert got[0].agg == "SUM" and got[1] is None and got[2] is None


def test_sql_over_a_large_table(spark):
    df = spark.range(10)
    assert ask_sql(df, "SELECT max(id) FROM data_table") == "9"
    assert ask_sql(df, "SELECT id FROM data_table WHERE id > 99") == "None"
