"""Sample sets, replies and token streams derived from a plain star schema.

They stand in for a stored sample set: every question, passage, table and
equation comes from the given tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.functions.binding import let, settle
from askgrid.functions.hashing import digest, hash60
from askgrid.functions.numbers import bound_text, round2
from askgrid.functions.questions import AGGREGATES, question
from askgrid.operators.ranking import with_rank
from askgrid.schemas import SAMPLE, SAMPLE_FIELDS, blank_to_null
from askgrid.session import stored
from askgrid.sources.records import pack_numbers, table_json

LINE_KEYS = ["l_linenumber", "l_partkey", "l_suppkey"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").cast("string")


def pick_of(values: list[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def order_tables(spark: SparkSession, folder: str) -> DataFrame:
    """One record table per order: ``sample_id, l_orderkey, data``.

    Every other order has no ``types``, so its column types must be inferred.
    """
    lines = read(spark, folder, "lineitem")
    rows = pack_numbers(
        LINE_KEYS, ["l_returnflag", "l_quantity", "l_extendedprice"],
        lambda c: [
            whole(c("l_linenumber")), c("l_returnflag"), whole(c("l_quantity")),
            F.format_number(c("l_extendedprice"), 2),
        ],
    )
    typed = F.when(
        F.col("l_orderkey") % 2 == 0, F.array(*[F.lit(t) for t in ("real", "text", "real", "real")])
    )
    return (
        lines.groupBy("l_orderkey")
        .agg(rows.alias("rows"))
        .select(
            F.concat(F.lit("sql-"), "l_orderkey").alias("sample_id"),
            "l_orderkey",
            table_json(["line", "flag", "quantity", "price"], F.col("rows"), typed).alias("data"),
        )
    )


#: Columns that tell all order lines apart.
LINE_KEYS_OF_ALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All order lines as cells ``record, row, column, name, type, value, number``.

    Every third order's lines belong to one record, which so holds a third of all rows; rows
    of a record are numbered by the digests of their keys. Numbered lines are written once, since
    questions read cells more than once.
    """
    lines = read(spark, folder, "lineitem")
    record = F.when(F.col("l_orderkey") % 3 == 0, F.lit("large")).otherwise(F.concat(F.lit("sql-"), "l_orderkey"))
    keyed = lines.select(record.alias("record"), digest("row", *map(F.col, LINE_KEYS_OF_ALL)).alias("line_key"), "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    placed = stored(with_rank(keyed, "line_key", ["record"], "row").drop("line_key"), "lines")
    of = [
        ("line", "real", whole("l_linenumber"), F.col("l_linenumber").cast("double")), ("flag", "text", F.col("l_returnflag"), F.lit(None).cast("double")),
        ("quantity", "real", whole("l_quantity"), F.col("l_quantity")), ("price", "text", F.format_number("l_extendedprice", 2), F.lit(None).cast("double")),
    ]
    every = F.array(*[F.struct(F.lit(k).alias("column"), F.lit(n).alias("name"), F.lit(t).alias("type"), v.alias("value"), x.alias("number")) for k, (n, t, v, x) in enumerate(of)])
    return placed.select("record", F.col("row").cast("long").alias("row"), F.inline(every))


def order_question() -> Column:
    """A question per order: the aggregates in turn, one or two conditions."""
    flag = F.struct(F.lit("flag").alias("col"), F.lit("=").alias("op"), F.lit("R").alias("val"))
    many = F.struct(F.lit("quantity").alias("col"), F.lit(">").alias("op"), F.lit("25").alias("val"))
    conds = F.when(F.col("l_orderkey") % 3 == 0, F.array(flag, many)).otherwise(F.array(flag))
    return question("quantity", pick_of(AGGREGATES, F.col("l_orderkey") % 5), conds)


def script_samples(spark: SparkSession, folder: str) -> DataFrame:
    q = F.to_json(order_question())
    agg = pick_of(AGGREGATES, F.col("l_orderkey") % 5)
    wording = F.concat(
        F.lit("What is the "), agg, F.lit(" of quantity where the flag is R"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit(" and the quantity is above 25")).otherwise(F.lit("")),
        F.lit("?"),
    )
    return order_tables(spark, folder).select(
        "sample_id",
        wording.alias("instruction"),
        F.lit("").alias("input"),
        "data",
        F.lit("script").alias("template"),
        F.lit("wiki-sql").alias("source"),
        F.lit("").alias("derivation_eval"),
        q.alias("derivation_sql"),
        F.concat(F.lit("order "), "l_orderkey").alias("output"),
    )


def line_equations(spark: SparkSession, folder: str) -> DataFrame:
    """One equation per order line, in six shapes, with the amounts behind it.

    ``a`` and ``b`` are money amounts, ``q`` and ``n`` whole numbers; ``kind`` says
    which shape the line got.
    """
    lines = read(spark, folder, "lineitem").select(
        F.concat_ws("-", F.lit("tat"), "l_orderkey", *LINE_KEYS, whole("l_quantity")).alias("sample_id"),
        F.col("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("n"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_extendedprice").alias("a"),
        (F.col("l_quantity") * 1000).alias("b"),
        F.col("l_linestatus"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
    ).withColumn("kind", F.pmod(F.col("l_orderkey") + F.col("n"), F.lit(6)))
    a, b = F.format_number("a", 2), F.format_number("b", 2)
    plain_a, plain_b = F.replace(a, F.lit(","), F.lit("")), F.replace(b, F.lit(","), F.lit(""))
    q, n = F.col("q").cast("string"), F.col("n").cast("string")
    kind = F.col("kind")
    equation = (
        F.when(kind == 0, F.concat(F.lit("($"), a, F.lit(" - $"), b, F.lit(") / $"), b))
        .when(kind == 1, F.concat(F.lit("("), plain_a, F.lit(" + "), plain_b, F.lit(")/2")))
        .when(kind == 2, F.concat(plain_a, F.lit(" * "), q))
        .when(kind == 3, F.concat(q, F.lit(" * "), n))
        .when(kind == 4, F.concat(F.lit("$"), a, F.lit(" / ("), n, F.lit(" - 1)")))
        .otherwise(F.concat(q, F.lit("% - "), n, F.lit("%")))
    )
    return lines.withColumn("equation", equation)


def arithmetic_samples(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_equations(spark, folder)
    a, b, q, n, kind = (F.col(c) for c in ("a", "b", "q", "n", "kind"))
    ratio = (
        F.when(kind == 0, (a - b) / b * 100.0)
        .when(kind == 1, (a + b) / 2.0)
        .when(kind == 2, a * q)
        .when((kind == 4) & (n != 1), F.try_divide(a, n - 1))
    )
    whole_number = F.when(kind == 3, q * n).when(kind == 5, q - n).cast("string")
    gold = F.coalesce(whole_number, let(ratio, lambda x: bound_text(round2(x))), F.lit("n/a"))
    row = F.array(F.array(q.cast("string"), F.format_number("a", 2)))
    return lines.select(
        "sample_id",
        F.concat(F.lit("Work out figure "), kind, F.lit(" for line "), n, F.lit(".")).alias("instruction"),
        F.when(
            n % 2 == 0,
            F.concat(F.lit("The line has status "), "l_linestatus", F.lit(" and was shipped on "), "shipped", F.lit(".")),
        ).otherwise(F.lit("")).alias("input"),
        table_json(["quantity", "price"], row, F.array(F.lit("real"), F.lit("real"))).alias("data"),
        F.lit("arithmetic").alias("template"),
        F.lit("tat-qa").alias("source"),
        F.col("equation").alias("derivation_eval"),
        F.lit("").alias("derivation_sql"),
        gold.alias("output"),
    )


def _text_sample(template: str, source: str, **cols: Column | str) -> list[Column]:
    given = {"template": F.lit(template), "source": F.lit(source), **cols}
    return [F.col("sample_id")] + [
        (given[f] if f in given else F.lit("")).alias(f) for f in SAMPLE_FIELDS
    ]


def chat_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn and the assistant turn right after it.

    Joining on conversation and turn spreads even one endless conversation.
    """
    turns = read(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("asked"))
    told = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("told")
    )
    pairs = asked.join(told, ["conv_id", "turn"]).withColumn(
        "sample_id", F.concat_ws("-", F.lit("alp"), "conv_id", "turn")
    )
    return pairs.select(
        *_text_sample("generic", "alpaca", instruction=F.col("asked"), output=F.col("told"))
    )


def sentiment_samples(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    marked = docs.join(read(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
    return marked.withColumn("sample_id", F.concat(F.lit("sen-"), "doc_id")).select(
        *_text_sample(
            "generic", "phrase-bank",
            instruction=F.lit("What is the sentiment of this text?"), input=F.col("text"),
            output=F.when(F.col("quality") == 1, F.lit("positive")).otherwise(F.lit("negative")),
        )
    )


def passage_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A passage and a one-row table about the order of the same number."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    orders = read(spark, folder, "orders").withColumnRenamed("o_orderkey", "doc_id")
    row = F.array(F.array(
        F.col("o_orderstatus"), F.format_number("o_totalprice", 2), F.col("o_orderpriority"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
    ))
    types = F.array(*[F.lit(t) for t in ("text", "real", "text", "text")])
    data = table_json(["status", "total", "priority", "date"], row, types)
    return docs.join(orders, "doc_id").withColumn("sample_id", F.concat(F.lit("ott-"), "doc_id")).select(
        *_text_sample(
            "table", "ott-qa",
            instruction=F.lit("What is the order status?"), input=F.col("text"), data=data,
            output=F.col("o_orderstatus"),
        )
    )


def routing_samples(kind: DataFrame) -> DataFrame:
    """Router training twins: same question, the route as the answer."""
    return kind.withColumns({
        "sample_id": F.concat(F.lit("route-"), "sample_id"),
        "output": F.col("template"),
        "template": F.lit("template"),
        "derivation_eval": F.lit(""),
        "derivation_sql": F.lit(""),
    })


def split_of(sample_id: Column) -> Column:
    first = F.substring(digest("split", sample_id), 1, 1)
    return F.when(first.isin("0", "1"), F.lit("test")).when(first == "2", F.lit("val")).otherwise(F.lit("train"))


def finish(df: DataFrame) -> DataFrame:
    full = df.withColumn("split", split_of(F.col("sample_id")))
    return blank_to_null(full.select(*[F.col(f.name) for f in SAMPLE]))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """The whole sample set."""
    chats, passages = chat_samples(spark, folder), passage_samples(spark, folder)
    parts = [
        script_samples(spark, folder), arithmetic_samples(spark, folder), chats,
        sentiment_samples(spark, folder), passages, routing_samples(chats), routing_samples(passages),
    ]
    return finish(reduce(DataFrame.unionByName, parts))


def stored_samples(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`samples` as a stored set, for jobs that read it more than once: its rows are made once, and readers take the columns they need."""
    return stored(samples(spark, folder), "samples")


def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One reply per conversation turn as tokens, with an end mark and a few tokens after it."""
    turns = read(spark, folder, "conversations")
    text = F.concat(F.lit("### Response:\n"), "text")
    tokens = F.concat(
        F.transform(F.split(text, " "), lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.lit(" "), t))),
        F.array(F.lit("</s>"), F.lit(" late"), F.lit(" tokens")),
    )
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"),
        F.posexplode(tokens).alias("pos", "token"),
    )


def sent_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`token_stream` as a channel delivers it: with times, one token in 128 lost, one in sixteen sent twice."""
    sent = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("pos") * 10)
    place = [F.col("request_id"), F.col("pos")]
    kept = token_stream(spark, folder).withColumn("sent_at", sent).where(hash60("lost", *place) % 128 != 0)
    return kept.unionByName(kept.where(hash60("twice", *place) % 16 == 0))


def answer_outputs(df: DataFrame, templates: dict) -> DataFrame:
    """Samples with ``raw_output``: the decoded text a model would have returned.

    Most rows reply with the gold step; some with blanks around it, a repeated or
    missing separator, or nonsense; some rows have no reply.
    """
    from askgrid.operators.prompts import inference_prompt, training_target
    from askgrid.operators.replies import separator_of

    digit = F.col("reply_digit")
    prompt = F.concat(F.lit("<s> "), inference_prompt(templates))
    gold = F.coalesce(training_target(), F.lit(""))
    output = (
        F.when(digit == "f", F.lit(None))
        .when(digit == "e", F.concat(prompt, F.lit("no answer")))
        .when(digit == "d", gold)
        .when(digit == "c", F.concat(prompt, gold, separator_of(templates, F.col("template")), F.lit("again</s>")))
        .when(digit == "b", F.concat(prompt, F.lit("  \n"), gold, F.lit(" \n</s>")))
        .otherwise(F.concat(prompt, gold, F.lit("</s>")))
    )
    return _with_output(df, "answer", output)


def _with_output(df: DataFrame, stage: str, output: Column) -> DataFrame:
    """Settle ``raw_output``, which asks several times for ``reply_digit``; that is worked out once a row."""
    drawn = df.withColumn("reply_digit", F.substring(digest(stage, F.col("sample_id")), 1, 1))
    return settle(drawn, "raw_output", output).drop("reply_digit")


def route_outputs(df: DataFrame, templates: dict) -> DataFrame:
    """Samples with ``raw_output`` of the routing call: some name no known route or lack the mark."""
    from askgrid.operators.prompts import inference_prompt

    digit = F.col("reply_digit")
    prompt = F.concat(F.lit("<s> "), inference_prompt(templates, F.lit("template")))
    route = F.when(F.col("template") == "template", F.lit("generic")).otherwise(F.col("template"))
    output = (
        F.when(digit == "f", route)
        .when(digit == "e", F.concat(prompt, F.lit("equation</s>")))
        .when(digit == "d", F.concat(prompt, F.lit("table</s>")))
        .otherwise(F.concat(prompt, route, F.lit("</s>")))
    )
    return _with_output(df, "route", output)


def replies(df: DataFrame, templates: dict) -> DataFrame:
    """The reply table ``(sample_id, stage, output)`` of both model calls."""
    of_route = route_outputs(df, templates).select("sample_id", F.lit("route").alias("stage"), F.col("raw_output").alias("output"))
    of_answer = answer_outputs(df, templates).select("sample_id", F.lit("answer").alias("stage"), F.col("raw_output").alias("output"))
    return of_route.unionByName(of_answer).where(F.col("output").isNotNull())


def results(df: DataFrame, variant: str) -> DataFrame:
    """Result rows of a model variant: right, right in another spelling, or wrong."""
    from askgrid.operators.select import result_rows

    digit = F.substring(digest(variant, F.col("sample_id")), 1, 1)
    gold = F.col("output")
    respelled = F.when(F.col("source") == "phrase-bank", F.upper(gold)).otherwise(gold)
    pred = (
        F.when(digit < "8", gold)
        .when(digit == "8", F.concat(F.lit(" "), respelled, F.lit("\n")))
        .when(digit == "9", F.concat(gold, F.lit("%")))
        .when(digit == "a", F.concat(F.lit("$"), gold))
        .otherwise(F.lit("wrong"))
    )
    return result_rows(df.withColumns({"pred": pred, "pred_eval": gold_step()}))


def gold_step() -> Column:
    return F.coalesce("derivation_eval", "derivation_sql")


def earlier_results(df: DataFrame) -> DataFrame:
    """Results of about half of the rows, from an interrupted run."""
    half = F.substring(digest("done", F.col("sample_id")), 1, 1) < "8"
    return results(df.where(half), "earlier")
