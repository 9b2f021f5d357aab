"""Cells are made once, and small groups are ranked at once."""

from pyspark.sql import functions as F

from askgrid.functions.questions import question
from askgrid.operators import cells as OC
from askgrid.operators import ranking
from askgrid.operators.ranking import with_rank
from askgrid.sources import fixtures as X
from askgrid.sources.records import pack_rows


def lines(spark):
    return spark.createDataFrame(
        [(o, n, o * 7 + n, 1, "RAN"[n % 3], float(10 * n + o % 9), 100.5 * n) for o in range(1, 61) for n in range(1, 6)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double",
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_read_written_lines(spark, tmp_path):
    lines(spark).write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = X.line_cells(spark, str(tmp_path))
    assert cells.count() == 1200 and "Exchange" not in plan_of(cells)
    places = cells.where("column = 0").groupBy("record").agg(F.count("*").alias("n"), F.countDistinct("row").alias("d"), F.max("row").alias("m"))
    assert places.where("n <> d OR m <> n - 1").count() == 0 and places.where("record = 'large'").first()["n"] == 100


def test_groups_of_any_size_are_ranked_alike(spark, monkeypatch):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 5 == 4, None).when(F.col("id") < 3000, "large").otherwise(F.concat(F.lit("g"), F.col("id") % 700)).alias("g"),
        F.md5(F.col("id").cast("string")).alias("o"),
    )
    held = {}
    for r in rows.collect():
        held.setdefault(r["g"], []).append(r["o"])
    want = sorted((str(g), o, n) for g, found in held.items() for n, o in enumerate(sorted(found)))
    for at_once in (1 << 16, 300, 40, 2):
        monkeypatch.setattr(ranking, "ROWS_AT_ONCE", at_once)
        assert sorted((str(r["g"]), r["o"], r["rank"]) for r in with_rank(rows, "o", ["g"]).collect()) == want


def cells_of(spark, rows):
    return spark.createDataFrame(
        [("r", n, k, c, "real" if c == "q" else "text", v, float(v) if c == "q" else None) for n, r in enumerate(rows) for k, (c, v) in enumerate(zip(("flag", "q", "other"), r))],
        "record string, row long, column int, name string, type string, value string, number double")


def test_aggregates_share_the_rows_that_satisfy(spark, monkeypatch):
    satisfying, seen = OC.satisfying_rows, []
    monkeypatch.setattr(OC, "satisfying_rows", lambda *a, **b: seen.append(satisfying(*a, **b)) or seen[-1])
    cells = cells_of(spark, [("RAN"[n % 3], str(n % 4), "x") for n in range(30)])
    aggs = spark.createDataFrame([("r", a, d) for a in ("MAX", "MIN", "COUNT", "SUM", "AVG", "LONGEST") for d in (False, True)], "record string, agg string, d boolean")
    conds = [("flag", "=", "R"), ("q", ">", "0")]
    questions = aggs.withColumn("question", F.when(F.col("d"), question("q", F.col("agg"), conds, is_distinct=True)).otherwise(question("q", F.col("agg"), conds)))
    found = {(r["agg"], r["d"]): (r["answer"]["value"], r["answer"]["status"]) for r in OC.answer_cells(cells, questions, ["record"], own_keys=["agg", "d"]).collect()}
    hits = [n % 4 for n in range(30) if n % 3 == 0 and n % 4]
    for d, some in ((False, hits), (True, sorted(set(hits)))):
        want = {"MAX": max(some), "MIN": min(some), "COUNT": len(some), "SUM": sum(some), "AVG": sum(some) / len(some)}
        assert {a: found[a, d][0] for a in want} == want and all(found[a, d][1] == "ok" for a in want)
        assert found["LONGEST", d][1] != "ok" and found["LONGEST", d][0] is None
    # Once for all plain aggregates, once for the three that fold equal values.
    assert seen[0].count() == 2 * len(hits)


def test_only_cells_that_matter_are_counted(spark):
    cells = cells_of(spark, [("RAN"[n % 3], str(n), "x") for n in range(30)])
    asked = spark.createDataFrame([("r",)], "record string").withColumn("question", question("q", "SUM", [("flag", "=", "R")]))
    named, plain, keys = OC._plain(cells, asked, ["record"], "question")
    rows = OC.satisfying_rows(named, OC.asked_of(named, plain, keys), keys)
    assert rows.count() == 10 and "cell_met" in plan_of(rows)
    for conds, want in (([], 30), ([("other", "=", "x")], 30), ([("flag", "=", "Z")], 0)):
        counted = asked.withColumn("question", question("*", "COUNT", conds))
        assert OC.answer_cells(cells, counted, ["record"]).first()["answer"]["value"] == want


def test_order_tables_are_gathered_as_numbers(spark, tmp_path):
    rows = [(o, n, p, 1, f, q, x) for o in range(1, 9) for n, p, f, q, x in (
        (2, 1, "R", 10.0, 1234.5), (1, 3, None, 9.0, None), (1, 3, "A", 100.0, 2.0), (1, 3, "A", 20.0, 3.0), (None, None, "N", None, 1e7), (2, 1, "R", 10.0, 1234.5))]
    kind = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    tables = X.order_tables(spark, str(tmp_path))
    lines = plan_of(tables).split("\n")
    exchange = next(n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line)
    assert not any("format_number" in line for line in lines[exchange:])
    cells = [X.whole("l_linenumber"), F.col("l_returnflag"), X.whole("l_quantity"), F.format_number("l_extendedprice", 2)]
    old = spark.read.parquet(f"{tmp_path}/lineitem.parquet").groupBy("l_orderkey").agg(F.to_json(pack_rows(X.LINE_KEYS, cells)).alias("rows"))
    found = tables.join(old, "l_orderkey").select("l_orderkey", F.contains("data", F.concat(F.lit('"rows":'), "rows")).alias("same")).collect()
    assert len(found) == 8 and all(r["same"] for r in found)
