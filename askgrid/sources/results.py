"""Result sets as partitioned tables and as CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.schemas import RESULT


def run_hour(at: Column) -> Column:
    """The hour stamp of a run: ``YYYYMMDD_HH``."""
    return F.date_format(at, "yyyyMMdd_HH")


def write_results(df: DataFrame, path: str, model: str, variant: str, at: Column | None = None) -> None:
    """Append results below model, variant and run hour."""
    hour = run_hour(at if at is not None else F.current_timestamp())
    stamped = df.withColumns({"model": F.lit(model), "variant": F.lit(variant), "run_hour": hour})
    stamped.write.mode("append").partitionBy("model", "variant", "run_hour").parquet(path)


def read_results(spark: SparkSession, path: str, model: str | None = None, variant: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if model is not None:
        df = df.where(F.col("model") == model)
    if variant is not None:
        df = df.where(F.col("variant") == variant)
    return df


def write_results_csv(df: DataFrame, path: str) -> None:
    """CSV with quotes doubled and line breaks kept inside fields, in gzip: such files aren't cut for reading anyway."""
    (
        df.write.mode("overwrite")
        .option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n")
        .option("compression", "gzip")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results; a blank field is read as null."""
    return (
        spark.read.schema(RESULT)
        .option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def flag_rows(df: DataFrame, path: str, at: Column | None = None) -> None:
    """Append flagged inputs and outputs to the log, by day."""
    day = F.to_date(at if at is not None else F.current_timestamp())
    df.withColumn("flag_date", day).write.mode("append").partitionBy("flag_date").parquet(path)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
