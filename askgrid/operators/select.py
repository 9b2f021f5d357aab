"""Row filters, projections and routing rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askgrid.functions.text import cut_between
from askgrid.schemas import KEY_FIELDS

# The routes a prediction may name, and the text that introduces one.
ROUTES = ["table", "arithmetic", "script", "generic"]
ROUTE_MARK = "### Template:"
TOKEN_LIMIT = 1024


def without_routing(df: DataFrame) -> DataFrame:
    """Training rows when tools are off."""
    return df.where(F.col("template") != "template")


def evaluation_rows(df: DataFrame, adapter: bool = True, tools: bool = True) -> DataFrame:
    """Everything for the tuned model with tools; else only chat rows."""
    if adapter and tools:
        return df
    return without_routing(df).where(F.col("source") == "alpaca")


def external_model_rows(df: DataFrame) -> DataFrame:
    return without_routing(df).where(F.col("source") != "alpaca")


def gold_eval() -> Column:
    """The equation if there is one, else the table question."""
    return F.coalesce(F.nullif(F.col("derivation_eval"), F.lit("")), F.col("derivation_sql"))


def result_rows(df: DataFrame, pred: str = "pred", pred_eval: str = "pred_eval") -> DataFrame:
    """Project to the fixed result columns."""
    return df.select(
        *KEY_FIELDS, F.col("output").alias("gold"), gold_eval().alias("gold_eval"),
        F.col(pred).alias("pred"), F.col(pred_eval).alias("pred_eval"),
    )


def split_by_length(df: DataFrame, n_tokens: str = "n_tokens", limit: int = TOKEN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows short enough to evaluate, and the rest for an audit."""
    fits = F.col(n_tokens) < limit
    return df.where(fits), df.where(~F.coalesce(fits, F.lit(False)))


def example_rows(df: DataFrame) -> DataFrame:
    return df.select("instruction", "input", "data", "output")


def concat_results(*parts: DataFrame) -> DataFrame:
    """Stack result sets by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def baseline_route(adapter: bool) -> Column:
    """Without an adapter, sentiment rows get their own route."""
    if adapter:
        return F.col("template")
    return F.when(F.col("source") == "phrase-bank", F.lit("sentiment")).otherwise(F.col("template"))


def accepted_route(predicted: Column, route: Column) -> Column:
    """A predicted route counts only if it is a known one."""
    return F.when(predicted.isin(ROUTES), predicted).otherwise(route)


def interactive_route(asked: Column, predicted: Column) -> Column:
    """``auto`` takes the prediction; everything unknown becomes ``generic``."""
    route = F.when(asked == "auto", predicted).otherwise(asked)
    return F.when(route.isin(ROUTES), route).otherwise(F.lit("generic"))


def route_from_output(output: Column) -> Column:
    """Route named after the route mark; the whole output if the mark is absent."""
    return F.coalesce(cut_between(output, F.lit(ROUTE_MARK)), output)


def parsing_route(route: Column, use_tools: bool) -> Column:
    """Without tools every reply is plain text."""
    return route if use_tools else F.lit("generic")
