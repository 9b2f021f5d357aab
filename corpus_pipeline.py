"""A corpus pipeline of the operators in ``askgrid.llm``: documents in, token ids out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import bpe, decontaminate, simhash, substrings, toxicity
from askgrid.session import new_path


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python workers get at most so many rows at once: texts of many tasks and stages share an executor's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    bounded_batches(spark)
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, chain)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints differ in two bits at most the smallest id stays."""
    bounded_batches(spark)
    return simhash.keep_one_of_each_group(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that stand in windows of 13 which a document with a smaller id has; other texts stay as they are."""
    bounded_batches(spark)
    found = substrings.without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth stands in benchmark windows."""
    bounded_batches(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    bounded_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select(*docs.columns, F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", bpe_stage),
]
#: SQL has no classifier, fingerprints or merges: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
