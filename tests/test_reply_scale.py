"""A reply's digit and its question are worked out once a row."""

from pyspark.sql import functions as F

from askgrid.functions.questions import parse_question
from askgrid.schemas import SAMPLE
from askgrid.sources import fixtures as X
from catalog.base import TOOLS


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_digest_for_each_output(spark):
    rows = spark.createDataFrame([], SAMPLE).repartition(1)
    for outputs in (X.answer_outputs, X.route_outputs):
        made = outputs(rows, TOOLS)
        assert made.columns == [*rows.columns, "raw_output"] and plan_of(made).count("md5(") == 1


def test_a_question_is_read_once(spark):
    texts = spark.createDataFrame(
        [(1, '{"agg":"MAX","pick":"a"}'), (2, '{"agg":"COUNT"}'), (3, "{}"), (4, "no question"), (5, None)], "id int, text string"
    ).repartition(1)
    asked = texts.select("id", parse_question(F.col("text")).alias("q"))
    assert plan_of(asked).count("from_json(") == 1
    found = {r["id"]: r["q"] for r in asked.collect()}
    assert (found[1]["agg"], found[1]["pick"], found[2]["agg"]) == ("MAX", "a", "COUNT") and found[3] is found[4] is found[5] is None
