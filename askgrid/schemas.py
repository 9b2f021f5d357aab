"""Row shapes shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_FIELDS = [
    "instruction", "input", "data", "template", "source",
    "derivation_eval", "derivation_sql", "output",
]
SAMPLE = T.StructType(
    [T.StructField("sample_id", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in SAMPLE_FIELDS]
    + [T.StructField("split", T.StringType())]
)

RESULT_FIELDS = [
    "source", "template", "instruction", "input", "data",
    "gold", "gold_eval", "pred", "pred_eval",
]
RESULT = T.StructType([T.StructField(name, T.StringType()) for name in RESULT_FIELDS])

# The columns that identify a question across runs.
KEY_FIELDS = ["source", "template", "instruction", "input", "data"]

RECORD_TABLE = T.StructType([
    T.StructField("header", T.ArrayType(T.StringType())),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("types", T.ArrayType(T.StringType())),
])

CONDITION = T.StructType([
    T.StructField("col", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("val", T.StringType()),
])
QUESTION = T.StructType([
    T.StructField("agg", T.StringType()),
    T.StructField("pick", T.StringType()),
    T.StructField("conds", T.ArrayType(CONDITION)),
    T.StructField("group_col", T.StringType()),
    T.StructField("order_col", T.StringType()),
    T.StructField("descending", T.BooleanType()),
    T.StructField("is_distinct", T.BooleanType()),
    T.StructField("limit", T.IntegerType()),
])

FLAGGED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("instruction", "input", "data", "template")]
    + [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("top_p", T.DoubleType()),
        T.StructField("beams", T.IntegerType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("stream", T.BooleanType()),
    ]
    + [T.StructField(n, T.StringType()) for n in ("result", "eval", "template_used")]
)

TOKEN = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("token", T.StringType()),
])


def blank_to_null(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Make ``''`` and null the same thing once, at load."""
    names = names or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.nullif(F.col(n), F.lit("")) for n in names})
