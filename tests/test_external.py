"""The external job: every row once, and tables asked by SQL text."""

from askgrid.operators.tables import run_sql
from askgrid.plans.evaluation import external_job, external_results
from askgrid.schemas import RESULT, SAMPLE
from askgrid.sources.templates import load_templates
from catalog.base import CHAT

TOOLS = load_templates()


def rows_of(spark, rows):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in SAMPLE} for r in rows], SAMPLE)


def row(name, **fields):
    return {"sample_id": name, "source": "s", "template": "table", "instruction": f"Q {name}", "input": "", "data": "T", "output": f"gold {name}"} | fields


def job_of(spark, k=2, **options):
    tests = rows_of(spark, [
        row("new"), row("done"), row("long", instruction="word " * 5000), row("rare", source="r"),
        row("none", instruction=None), row("chat", source="alpaca"), row("route", template="template"),
    ])
    pool = rows_of(spark, [row("p1"), row("p2"), row("p3", source="r")])
    done = {f.name: row("done").get(f.name) for f in RESULT}
    results = spark.createDataFrame([done | {"input": None}], RESULT)
    replies = spark.createDataFrame([("p1", "Because.\n###Answer: 7"), ("p1", "A")], "sample_id string, reply string")
    return external_job(tests, pool, results, CHAT, k, 3, shot_replies=replies, **options)


def test_every_row_is_asked_or_has_a_reason(spark):
    got = {r["sample_id"]: r for r in job_of(spark).collect()}
    assert set(got) == {"new", "done", "long", "rare", "none"}
    assert {n: r["reason"] for n, r in got.items() if n != "none"} == {
        "new": None, "done": "finished", "long": "over_budget", "rare": "pool_too_small"}
    assert all((r["messages"] is None) == (r["reason"] is not None) for r in got.values())
    text = got["new"]["messages"][1]["content"]
    assert text.startswith("Example 1\n\n") and "Now answer the following:" in text
    assert "Because.\n###Answer: gold p1" in text and "Not evaluated###Answer: gold p2" in text


def test_without_shots(spark):
    got = {r["sample_id"]: r["reason"] for r in job_of(spark, k=0).collect()}
    assert got["rare"] is None and got["done"] == "finished" and got["long"] == "over_budget"


def test_results_and_reasons_are_all_rows(spark):
    replies = spark.createDataFrame([("new", "answer", "So.\n###Answer: x ###Answer: 12 ")], "sample_id string, stage string, output string")
    found, left_out = external_results(job_of(spark, k=0), replies)
    (only,) = found.collect()
    assert only["pred"] == "12" and only["gold"] == "gold new"
    reasons = {r["sample_id"]: r["reason"] for r in left_out.collect()}
    assert reasons["rare"] == "no_reply" and reasons["done"] == "finished" and len(reasons) == 4


def test_no_rows(spark):
    none = rows_of(spark, [row("x")]).where("false")
    got = external_job(none, none, spark.createDataFrame([], RESULT), CHAT, 2, shot_replies=spark.createDataFrame([], "sample_id string, reply string"))
    assert got.count() == 0


def test_sql_texts_in_one_session_do_not_meet(spark):
    spark.range(3).createOrReplaceTempView("data_table")
    one, two = (run_sql(spark.range(n), "SELECT count(*) AS n, '{}' AS braces FROM data_table;") for n in (5, 8))
    assert [tuple(x.first()) for x in (one, two)] == [(5, "{}"), (8, "{}")]
    assert spark.table("data_table").count() == 3
    nested = run_sql(spark.range(9), "WITH big AS (SELECT * FROM data_table WHERE id > 4) SELECT id FROM big ORDER BY id DESC LIMIT 2 -- two")
    assert [r[0] for r in nested.collect()] == [8, 7]
    spark.catalog.dropTempView("data_table")
