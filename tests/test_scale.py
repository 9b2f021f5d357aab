"""Work that grows with the input is shared by as many tasks as there are."""

import glob
import hashlib
import os
import re

from pyspark.sql import functions as F

from askgrid.llm import fingerprints
from askgrid.operators import sampling as SA
from askgrid.operators.replies import attach_reply
from askgrid.schemas import RESULT
from askgrid.session import new_path, settings
from askgrid.sources.results import read_results_csv, write_results_csv
from catalog import sources


def test_steps_take_all_files_of_a_set_of_any_size(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        rows = sources.step_by_step(spark, sf)
    assert len(glob.glob(f"{tmp_path}/samples/part-*")) > 4 >= len(glob.glob(f"{tmp_path}/steps/step=*")) > 1
    assert rows.count() == spark.read.parquet(f"{tmp_path}/samples").count()


def test_no_task_meets_a_whole_group_of_shots(spark):
    pool = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("sample_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit("t").alias("template"))
    tests = pool.select(F.concat(F.lit("t"), "sample_id").alias("sample_id"), "source", "template").unionByName(
        spark.createDataFrame([("x", "other", "t")], pool.schema))
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "20k"}):
        picks, too_few = SA.few_shot_picks(tests, pool, 3, 5)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (picks, too_few)]
    for plan in plans:
        assert not re.search(r"SortMergeJoin(\(skew=true\))? \[shot_group#\d+\],", plan)
    assert picks.count() == 9000 and [tuple(r) for r in too_few.collect()] == [("x", "other", "t", 0)]


def test_results_are_written_small(spark):
    rows = spark.range(1000).select(*[F.concat(F.lit(f"{c} \"of\"\n"), F.col("id") % 7).alias(c) for c in RESULT.names])
    path = new_path(spark, "csv-small")
    write_results_csv(rows, path)
    size = sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))
    text = rows.agg(F.sum(F.length(F.concat(*RESULT.names)))).first()[0]
    assert size < text / 5
    assert read_results_csv(spark, path).exceptAll(rows).count() == 0 and read_results_csv(spark, path).count() == 1000


def test_replies_are_shuffled_before_they_are_sorted(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    replies = spark.createDataFrame(
        [("a", "answer", "x"), ("a", "answer", "y"), ("a", "route", "z"), ("b", "answer", None), (None, "answer", "n")],
        "sample_id string, stage string, output string")
    once = attach_reply(rows, replies, "answer", "raw", few_copies=True)
    lines = once._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = {kind: [n for n, line in enumerate(lines) if kind in line] for kind in ("SortAggregate", "REPARTITION_BY_NUM")}
    assert max(depth["SortAggregate"]) < min(depth["REPARTITION_BY_NUM"])  # the shuffle stands below both sorts
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, attach_reply(rows, replies, "answer", "raw").collect()), key=str)


def test_digests_are_shuffled_as_bytes(spark):
    docs = spark.createDataFrame([(n, f"some words of document {n}") for n in range(8)], "doc_id long, text string")
    near = fingerprints.compare_with_edited(docs, band=(0.0, 9.0))
    assert re.search(r"ReadSchema: \S*edited_sha256:binary", near._jdf.queryExecution().executedPlan().toString())
    rows = sorted(near.collect(), key=lambda r: r["id"])
    for r, n in zip(rows, range(8)):
        text, after = (f"some words of document {k % 8}" for k in (n, n + 1))
        quarter = len(text) // 4
        assert r["edited_sha256"] == hashlib.sha256((text[:-quarter] + after[:quarter]).encode()).hexdigest()
