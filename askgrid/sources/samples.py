"""Stored sample sets, laid out by split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.schemas import SAMPLE, blank_to_null


def write_samples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; the filter on the partition column skips the other folders."""
    return blank_to_null(spark.read.schema(SAMPLE).parquet(path).where(F.col("split") == split))
