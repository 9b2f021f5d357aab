"""Filters, projections and routing."""

from pyspark.sql import functions as F

from askgrid.functions.tokens import Encoder, vocabulary
from askgrid.operators import prompts as P
from askgrid.operators import replies as RP
from askgrid.operators import select as S
from askgrid.session import stored
from askgrid.sources import fixtures as X
from catalog.base import (
    ANSWER_OUT, CHAT, PIECES, ROUTE_OUT, SAMPLES, TOOLS, cut_sql, inference_sql, lit, results_sql,
)

IDS = ["sample_id", "source", "template"]
WORDS = 8000


def counted_sql(text, begin):
    """Ids of a text by the vocabulary of all these texts, pieces outside it by their bytes."""
    return f"""
asked AS (SELECT sample_id, {text} AS prompt FROM samples),
flat AS (SELECT sample_id, unnest({PIECES.format('prompt')}) AS piece FROM asked),
vocabulary AS (SELECT piece FROM (SELECT piece, count(*) AS n FROM flat GROUP BY piece) ORDER BY n DESC, piece LIMIT {WORDS}),
sizes AS (SELECT f.sample_id, sum(CASE WHEN v.piece IS NULL THEN strlen(f.piece) ELSE 1 END) AS n FROM flat f LEFT JOIN vocabulary v USING (piece) GROUP BY f.sample_id),
counted AS (SELECT sample_id, CASE WHEN prompt IS NOT NULL THEN CAST({begin} + coalesce(n, 0) AS INT) END AS n_tokens FROM asked LEFT JOIN sizes USING (sample_id))"""


def lengths(spark, sf):
    rows = X.samples(spark, sf).withColumn("prompt", P.inference_prompt(TOOLS))
    encoder = Encoder(vocabulary(rows, "prompt", WORDS))
    return S.split_by_length(counted_once(rows.withColumn("n_tokens", encoder.count(F.col("prompt")))))


def counted_once(rows):
    """Both sides of a gate are read from stored counts: texts are built and counted once."""
    return stored(rows.select("sample_id", "n_tokens"), "counts")


def length_gate(spark, sf):
    return kept_and_dropped(*lengths(spark, sf))


def kept_and_dropped(kept, dropped):
    cols = ["sample_id", "n_tokens"]
    return kept.select(*cols, F.lit(True).alias("kept")).unionByName(dropped.select(*cols, F.lit(False).alias("kept")))


def budget_gate(spark, sf):
    rows = X.samples(spark, sf).withColumn("prompt", P.inference_prompt(CHAT, F.lit("generic-3")))
    chat = rows.withColumn("messages", P.chat_messages(CHAT, F.col("prompt")))
    texts = chat.withColumn("chat", P.chat_text(F.col("messages")))
    counted = texts.withColumn("n_tokens", Encoder(vocabulary(texts, "chat", WORDS)).count(F.col("chat"), begin=False))
    return kept_and_dropped(*S.split_by_length(counted_once(counted), limit=4096))


def stacked_results(spark, sf):
    rows = X.samples(spark, sf)
    second = X.results(rows, "b").drop("pred_eval")
    return S.concat_results(X.results(rows, "a"), second).select(
        "source", "template", "instruction", F.md5("data").alias("data_md5"), "gold", "pred", "pred_eval"
    )


def routed(spark, sf):
    return X.route_outputs(X.samples(spark, sf), TOOLS)


def predicted_route(spark, sf):
    predicted = RP.cut_reply(TOOLS, F.col("raw_output"), F.lit("template"))
    return routed(spark, sf).select("sample_id", predicted.alias("predicted"), S.accepted_route(predicted, F.col("template")).alias("route"))


def interactive_route(spark, sf):
    predicted = RP.cut_reply(TOOLS, F.col("raw_output"), F.lit("template"))
    asked = F.when(F.col("source") == "tat-qa", F.lit("equation")).when(
        F.col("source") == "alpaca", F.col("template")).otherwise(F.lit("auto"))
    return routed(spark, sf).select("sample_id", S.interactive_route(asked, predicted).alias("route"))


ROUTES = "('table','arithmetic','script','generic')"
PRED = cut_sql("raw_output", "'### Template:'")
CHAT_PROMPT = inference_sql(CHAT, "'generic-3'")
SYSTEM = lit(CHAT["generic-3"]["system_message_cot"])

QUERIES = {
    "b1_without_routing": (
        lambda spark, sf: S.without_routing(X.samples(spark, sf)).select(*IDS, "split"),
        f"{SAMPLES} SELECT sample_id, source, template, split FROM samples WHERE template <> 'template'"),
    "b2_evaluation_rows": (
        lambda spark, sf: S.evaluation_rows(X.samples(spark, sf), adapter=False).select(*IDS, "instruction"),
        f"{SAMPLES} SELECT sample_id, source, template, instruction FROM samples WHERE template <> 'template' AND source = 'alpaca'"),
    "b3_external_rows": (
        lambda spark, sf: S.external_model_rows(X.samples(spark, sf)).select(*IDS),
        f"{SAMPLES} SELECT sample_id, source, template FROM samples WHERE template <> 'template' AND source <> 'alpaca'"),
    "b4_result_rows": (
        lambda spark, sf: X.results(X.samples(spark, sf), "a"),
        f"{SAMPLES}, {results_sql('r', 'a')} SELECT * FROM r"),
    "b5_gold_eval": (
        lambda spark, sf: X.samples(spark, sf).select("sample_id", S.gold_eval().alias("gold_eval")),
        f"{SAMPLES} SELECT sample_id, coalesce(derivation_eval, derivation_sql) AS gold_eval FROM samples"),
    "b6_length_gate": (
        length_gate,
        f"{SAMPLES}, {counted_sql(inference_sql(TOOLS), 1)} SELECT sample_id, n_tokens, n_tokens < 1024 AS kept FROM counted"),
    "b7_budget_gate": (
        budget_gate,
        f"{SAMPLES}, {counted_sql(f'({SYSTEM} || chr(10) || ({CHAT_PROMPT}) || chr(10))', 0)} SELECT sample_id, n_tokens, n_tokens < 4096 AS kept FROM counted"),
    "b8_example_rows": (
        lambda spark, sf: S.example_rows(X.samples(spark, sf)),
        f"{SAMPLES} SELECT instruction, input, data, output FROM samples"),
    "b9_concat_results": (
        stacked_results,
        f"""{SAMPLES}, {results_sql('a', 'a')}, {results_sql('b', 'b')}
            SELECT source, template, instruction, md5(data) AS data_md5, gold, pred, pred_eval FROM a
            UNION ALL SELECT source, template, instruction, md5(data), gold, pred, NULL FROM b"""),
    "r1_baseline_route": (
        lambda spark, sf: X.samples(spark, sf).select("sample_id", S.baseline_route(False).alias("route")),
        f"{SAMPLES} SELECT sample_id, CASE WHEN source = 'phrase-bank' THEN 'sentiment' ELSE template END AS route FROM samples"),
    "r2_accepted_route": (
        predicted_route,
        f"""{SAMPLES}, {ROUTE_OUT} SELECT sample_id, predicted, CASE WHEN predicted IN {ROUTES} THEN predicted ELSE template END AS route
            FROM (SELECT *, {PRED} AS predicted FROM route_out)"""),
    "r3_interactive_route": (
        interactive_route,
        f"""{SAMPLES}, {ROUTE_OUT} SELECT sample_id, CASE WHEN asked IN {ROUTES} THEN asked ELSE 'generic' END AS route
            FROM (SELECT sample_id, CASE source WHEN 'tat-qa' THEN 'equation' WHEN 'alpaca' THEN template ELSE {PRED} END AS asked FROM route_out)"""),
    "r4_route_from_output": (
        lambda spark, sf: routed(spark, sf).select("sample_id", S.route_from_output(F.col("raw_output")).alias("route")),
        f"{SAMPLES}, {ROUTE_OUT} SELECT sample_id, coalesce({PRED}, raw_output) AS route FROM route_out"),
    "r5_parse_as_text": (
        lambda spark, sf: X.answer_outputs(X.samples(spark, sf), TOOLS).select(
            "sample_id", S.parsing_route(F.col("template"), False).alias("route"),
            RP.cut_reply(TOOLS, F.col("raw_output"), S.parsing_route(F.col("template"), False)).alias("result")),
        f"""{SAMPLES}, {ANSWER_OUT} SELECT sample_id, 'generic' AS route,
            {cut_sql('raw_output', lit(TOOLS['generic']['response_split']))} AS result FROM answer_out"""),
}
