"""Replies: attach, score, cut, equations, dispatch, whole evaluation."""

from pyspark.sql import functions as F

from askgrid.functions import equations as EQ
from askgrid.functions.hashing import digest
from askgrid.operators import prompts as P
from askgrid.operators import replies as RP
from askgrid.operators.equations import evaluate_equations
from askgrid.operators.select import external_model_rows
from askgrid.plans.evaluation import evaluate, external_job, external_results, interactive_answers, not_evaluated
from askgrid.sources import fixtures as X
from catalog.base import (
    ANSWERS, ANSWER_OUT, CHAT, COUNT, DONE, EQUATIONS, ROUTE_OUT, SAMPLES, TOOLS, cut_sql, inference_sql, lit, results_sql, separator_sql, training_sql,
)
from catalog.prompts import PICKS, SEED, SHOTS
from catalog.prompts import reply as shot_reply


def attached(spark, sf):
    rows = X.stored_samples(spark, sf)
    table = X.replies(rows, TOOLS)
    first = RP.attach_reply(rows.select("sample_id", "template"), table, "route", "route_output", few_copies=True)
    both = RP.attach_reply(first, table, "answer", "answer_output", few_copies=True)
    return both.select(
        "sample_id", F.md5("route_output").alias("route_md5"), F.md5("answer_output").alias("answer_md5")
    )


def stub_model(prompts):
    """A stand-in model: says how long the prompt is."""
    return [f"{len(p)} characters" for p in prompts]


def scored(spark, sf):
    rows = X.samples(spark, sf).select("sample_id", P.inference_prompt(TOOLS).alias("prompt"))
    return RP.score_batches(rows, stub_model).select("sample_id", "raw_output")


def cut(spark, sf):
    outputs = X.answer_outputs(X.samples(spark, sf), TOOLS)
    return outputs.select("sample_id", RP.cut_reply(TOOLS, F.col("raw_output"), F.col("template")).alias("result"))


def parsed(spark, sf):
    outputs = X.answer_outputs(X.samples(spark, sf), TOOLS)
    return RP.parse_replies(outputs, TOOLS, route="template")


def dispatched(spark, sf):
    return parsed(spark, sf).select("sample_id", "template", "result", "eval")


def packaged(spark, sf):
    packed = parsed(spark, sf).select("sample_id", RP.packaged("template").alias("p"))
    return packed.select("sample_id", "p.result", "p.eval", "p.template", F.md5("p.output").alias("output_md5"))


def equations(spark, sf):
    return evaluate_equations(X.line_equations(spark, sf), "equation").select(
        "sample_id", "eq_clean", "evaluated.result", "evaluated.value", "evaluated.status"
    )


def evaluation(spark, sf):
    rows = X.stored_samples(spark, sf).where(F.col("split") == "test")
    return evaluate(rows, X.replies(rows, TOOLS), TOOLS, few_copies=True)


def without_result(spark, sf):
    rows = X.stored_samples(spark, sf).where(F.col("split") == "test")
    return not_evaluated(rows, X.replies(rows, TOOLS), TOOLS, few_copies=True)


def interactive(spark, sf):
    rows = X.stored_samples(spark, sf)
    asked = F.when(F.col("source") == "tat-qa", F.lit("equation")).when(
        F.col("source") == "alpaca", F.col("template")).otherwise(F.lit("auto"))
    answered = interactive_answers(rows.withColumn("template", asked), X.replies(rows, TOOLS), TOOLS, few_copies=True)
    return answered.select("sample_id", "route", "result", "eval")


BUDGET = 600


def external_rows(spark, sf, reasoned):
    rows = X.stored_samples(spark, sf)
    tests, pool = rows.where(F.col("split") == "test"), external_model_rows(rows).where(F.col("split") == "train")
    known = F.substring(digest("reply", F.col("sample_id")), 1, 1) < "c"
    given = pool.where(known).select("sample_id", shot_reply().alias("reply"))
    return external_job(
        tests, pool, X.earlier_results(tests), CHAT if reasoned else CHAT | TOOLS, SHOTS, SEED, BUDGET, reasoned, True, given
    )


def external(spark, sf, reasoned):
    job = external_rows(spark, sf, reasoned)
    return job.select("sample_id", "reason", F.when(F.col("reason").isNull() | (F.col("reason") == "over_budget"), F.col("n_tokens")).alias("n_tokens"),
                      F.md5(F.get("messages", F.lit(1))["content"]).alias("user_md5"))


def external_answers(spark, sf):
    job = external_rows(spark, sf, True)
    digit = F.substring(digest("answer", F.col("sample_id")), 1, 1)
    output = F.when(digit < "6", F.concat(F.lit("So ###Answer: no ###Answer: "), "source")).when(
        digit < "c", F.concat(F.lit(" plain "), "template"))
    replies = X.samples(spark, sf).select("sample_id", F.lit("answer").alias("stage"), output.alias("output")).where("output IS NOT NULL")
    found, left_out = external_results(job, replies)
    got = found.groupBy("source", "template", "pred").agg(F.count(F.lit(1)).alias("rows")).withColumn("reason", F.lit(None).cast("string"))
    lost = left_out.groupBy("source", "template", "reason").agg(F.count(F.lit(1)).alias("rows")).withColumn("pred", F.lit(None).cast("string"))
    return got.unionByName(lost)


FAILED = """CASE kind_of WHEN 'script' THEN 'SQL is malformed: ' || reply || chr(10) || 'Exception:bad_question'
  WHEN 'arithmetic' THEN 'Equation is malformed: ' || reply || chr(10) || 'Exception:invalid syntax' ELSE reply END"""


def tool_results(route: str, source: str) -> str:
    """``result`` and ``eval`` of each reply, given the gold answers of the tools.

    A reply cut by a route other than the row's own is some other text than the gold step.
    """
    return f"""
    SELECT o.*, CASE WHEN reply IS NULL THEN NULL
        WHEN kind_of = 'script' AND reply = derivation_sql THEN a.result
        WHEN kind_of = 'arithmetic' AND reply = derivation_eval THEN e.result
        ELSE {FAILED} END AS result,
      CASE WHEN kind_of = 'script' THEN reply
           WHEN kind_of = 'arithmetic' THEN regexp_replace(reply, '[,%$]', '', 'g') END AS eval
    FROM (SELECT *, {route} AS kind_of, {cut_sql('raw_output', separator_sql(TOOLS, route))} AS reply FROM {source}) o
    LEFT JOIN answers a USING (sample_id) LEFT JOIN eq_results e USING (sample_id)"""


ALL = f"{SAMPLES}, {ANSWERS}, {ANSWER_OUT}"
ROUTES = "('table','arithmetic','script','generic')"
PREDICTED = cut_sql("raw_output", "'### Template:'")
ROUTED = f"""{SAMPLES}, {ANSWERS}, {ANSWER_OUT}, {ROUTE_OUT},
  predicted AS (SELECT sample_id, CASE WHEN {COUNT.format("(" + inference_sql(TOOLS, "'template'") + ")")} < 1024
      THEN {cut_sql('raw_output', "'### Template:'")} END AS predicted FROM route_out),
  routed AS (SELECT o.* EXCLUDE (template), o.template AS own, CASE WHEN predicted IN {ROUTES} THEN predicted ELSE o.template END AS template
      FROM answer_out o JOIN predicted USING (sample_id) WHERE split = 'test')"""
EVALUATION = f"""{ROUTED},
  short AS (SELECT * FROM routed WHERE {COUNT.format("(" + inference_sql(TOOLS) + ")")} < 1024
      AND ({inference_sql(TOOLS)}) IS NOT NULL AND raw_output IS NOT NULL)
  SELECT source, template, instruction, input, data, output AS gold, coalesce(derivation_eval, derivation_sql) AS gold_eval,
    result AS pred, eval AS pred_eval FROM ({tool_results('template', 'short')})"""

LEFT_OUT = f"""{ROUTED} SELECT * FROM (SELECT sample_id, source, own AS template, template AS route,
    CASE WHEN ({inference_sql(TOOLS)}) IS NULL THEN 'no_prompt' WHEN {COUNT.format("(" + inference_sql(TOOLS) + ")")} >= 1024 THEN 'too_long'
         WHEN raw_output IS NULL THEN 'no_reply' END AS reason FROM routed) WHERE reason IS NOT NULL"""
INTERACTIVE = f"""{ALL}, {ROUTE_OUT},
  wanted AS (SELECT sample_id, CASE source WHEN 'tat-qa' THEN 'equation' WHEN 'alpaca' THEN template ELSE {PREDICTED} END AS asked FROM route_out),
  routed AS (SELECT o.*, CASE WHEN asked IN {ROUTES} THEN asked ELSE 'generic' END AS route FROM answer_out o JOIN wanted USING (sample_id))
  SELECT sample_id, route, result, eval FROM ({tool_results('route', 'routed')})"""

SHOT_REPLY = "CASE WHEN substr(md5('reply|' || sample_id), 1, 1) < 'c' THEN 'Looking at ' || source || ' data.' || chr(10) ELSE 'Not evaluated' END"


def external_sql(prompt, shot, system):
    """Every external row with its prompt, its size and why it isn't asked."""
    return f"""{SAMPLES}, {PICKS}, all_tests AS (SELECT * FROM samples WHERE split = 'test'), {results_sql('done', 'earlier', DONE, 'all_tests')},
      keyed AS (SELECT DISTINCT source, template, coalesce(instruction, '') AS a, coalesce(input, '') AS b, coalesce(data, '') AS c FROM done),
      shots AS (SELECT sample_id, {shot} AS shot FROM pool),
      texts AS (SELECT p.sample_id, string_agg('Example ' || i || chr(10) || chr(10) || shot || chr(10) || chr(10), '' ORDER BY i) AS shot_text
                FROM picks p JOIN shots s ON s.sample_id = p.shot_id GROUP BY p.sample_id),
      prompted AS (SELECT *, {prompt} AS prompt FROM tests),
      job AS (SELECT t.sample_id, t.source, t.template, k.source IS NOT NULL AS finished, x.sample_id IS NULL AS small,
                shot_text || 'Now answer the following:' || chr(10) || chr(10) || prompt AS full_prompt
              FROM prompted t LEFT JOIN texts x USING (sample_id) LEFT JOIN keyed k ON k.source = t.source AND k.template = t.template
                AND k.a = coalesce(t.instruction, '') AND k.b = coalesce(t.input, '') AND k.c = coalesce(t.data, '')),
      counted AS (SELECT *, CAST({COUNT.format(f"({lit(system)} || chr(10) || full_prompt || chr(10))")} - 1 AS INT) AS n FROM job),
      judged AS (SELECT *, CASE WHEN finished THEN 'finished' WHEN small THEN 'pool_too_small' WHEN full_prompt IS NULL THEN 'no_prompt'
                WHEN n >= {BUDGET} THEN 'over_budget' END AS reason FROM counted)"""


REASONED_JOB = external_sql(
    inference_sql(CHAT, "'generic-3'"), f"({inference_sql(CHAT, chr(39) + 'generic-3' + chr(39))}) || {SHOT_REPLY} || '###Answer: ' || output",
    CHAT["generic-3"]["system_message_cot"])
PLAIN_JOB = external_sql(inference_sql(TOOLS), training_sql(TOOLS), CHAT["generic-3"]["system_message_default"])
EXTERNAL_SQL = """ SELECT sample_id, reason, CASE WHEN reason IS NULL OR reason = 'over_budget' THEN n END AS n_tokens,
    CASE WHEN reason IS NULL THEN md5(full_prompt) END AS user_md5 FROM judged"""
EXTERNAL_RESULTS = f"""{REASONED_JOB}, answered AS (SELECT source, template, reason, substr(md5('answer|' || sample_id), 1, 1) AS digit FROM judged),
    told AS (SELECT source, template, coalesce(reason, CASE WHEN digit >= 'c' THEN 'no_reply' END) AS reason,
        CASE WHEN digit < '6' THEN source WHEN digit < 'c' THEN 'plain ' || template END AS text FROM answered)
    SELECT source, template, CASE WHEN reason IS NULL THEN text END AS pred, reason, count(*) AS rows FROM told GROUP BY ALL"""
EQ_SQL = f"WITH {EQUATIONS} SELECT"
QUERIES = {
    "e3_attach_reply": (
        attached,
        f"""{SAMPLES}, {ANSWER_OUT}, {ROUTE_OUT} SELECT sample_id, md5(r.raw_output) AS route_md5, md5(a.raw_output) AS answer_md5
            FROM samples LEFT JOIN route_out r USING (sample_id) LEFT JOIN answer_out a USING (sample_id)"""),
    "e4_score_batches": (
        scored,
        f"""{SAMPLES} SELECT sample_id, length(prompt) || ' characters' AS raw_output
            FROM (SELECT sample_id, {inference_sql(TOOLS)} AS prompt FROM samples)"""),
    "f1_cut_reply": (
        cut,
        f"""{SAMPLES}, {ANSWER_OUT} SELECT sample_id, {cut_sql('raw_output', separator_sql(TOOLS))} AS result FROM answer_out"""),
    "f2_dispatch": (
        dispatched, f"{ALL} SELECT sample_id, template, result, eval FROM ({tool_results('template', 'answer_out')})"),
    "f3_clean_equation": (
        lambda spark, sf: X.line_equations(spark, sf).select("sample_id", EQ.clean(F.col("equation")).alias("eq_clean")),
        f"{EQ_SQL} sample_id, eq_clean FROM eq_results"),
    "f4_is_percentage": (
        lambda spark, sf: X.line_equations(spark, sf).select("sample_id", EQ.is_percentage(EQ.clean(F.col("equation"))).alias("is_percentage")),
        f"{EQ_SQL} sample_id, kind = 0 AS is_percentage FROM eq_results"),
    "f5_evaluate_equations": (
        lambda spark, sf: equations(spark, sf).select("sample_id", "value", "status"),
        f"{EQ_SQL} sample_id, value, status FROM eq_results"),
    "f6_number_text": (
        lambda spark, sf: equations(spark, sf).where("status = 'ok'").select("sample_id", "result"),
        f"{EQ_SQL} sample_id, result FROM eq_results WHERE status = 'ok'"),
    "f7_bad_equations": (
        lambda spark, sf: equations(spark, sf).where("status <> 'ok'").select("sample_id", "status", "result"),
        f"{EQ_SQL} sample_id, status, result FROM eq_results WHERE status <> 'ok'"),
    "f8_packaged_reply": (
        packaged,
        f"""{ALL} SELECT sample_id, result, eval, template, md5(raw_output) AS output_md5 FROM ({tool_results('template', 'answer_out')})"""),
    "evaluate_test_set": (evaluation, EVALUATION),
    "evaluate_not_evaluated": (without_result, LEFT_OUT),
    "interactive_answers": (interactive, INTERACTIVE),
    "external_job_reasoned": (lambda spark, sf: external(spark, sf, True), REASONED_JOB + EXTERNAL_SQL),
    "external_job_plain": (lambda spark, sf: external(spark, sf, False), PLAIN_JOB + EXTERNAL_SQL),
    "external_results": (external_answers, EXTERNAL_RESULTS),
}
