import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from askgrid.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert set(docs.columns) < set(out.columns) and 0 < out.count() <= docs.count()
    assert out.where(~F.col("round_trip")).count() == 0
    assert out.join(docs, "doc_id", "left_anti").count() == 0


def test_stages_take_odd_rows(spark, docs, wide_docs, no_docs, tmp_path):
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "some words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, no_docs, wide_docs):
            got = stage(spark, given, str(tmp_path))
            rest = [c for c in given.columns if c != "ids"] if name == "byte_bpe" else given.columns
            assert [c for c in got.columns if c in rest] == rest, name
            got.count()


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op3_warc", "op12_vector_codes", "op13_divergence")])
def test_a_row_for_each_document_or_page(spark, name):
    rows = queries.QUERIES[name][0](spark, DATA)
    table = "pages" if name == "op4_url_filter" else "documents"
    assert rows.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert "page_id" in rows.columns or "doc_id" in rows.columns
