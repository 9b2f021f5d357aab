"""Prompt construction, resume and few-shot picks."""

from pyspark.sql import functions as F

from askgrid.operators import prompts as P
from askgrid.operators import sampling as SA
from askgrid.operators.select import external_model_rows
from askgrid.session import new_path
from askgrid.sources import fixtures as X
from askgrid.sources.result_store import ResultStore
from catalog.base import (
    CHAT, DONE, HASH60, KIND, SAMPLES, TOOLS, inference_sql, lit, results_sql, training_sql,
)

SHOTS, SEED = 3, 7


def with_prompt(df, col, name="prompt"):
    return df.select("sample_id", F.length(col).alias(f"{name}_length"), F.md5(col).alias(f"{name}_md5"))


def template_lookup(spark, sf):
    found = P.with_template(X.samples(spark, sf), TOOLS)
    return found.select("sample_id", "prompt_kind", F.md5("template_text").alias("template_md5"), "response_split")


def tests_and_pool(spark, sf):
    rows = external_model_rows(X.stored_samples(spark, sf))
    return rows.where(F.col("split") == "test"), rows.where(F.col("split") == "train")


def unfinished(spark, sf):
    tests = X.samples(spark, sf).where(F.col("split") == "test")
    return SA.without_finished(tests, X.earlier_results(tests)).select("sample_id", "source", "template")


def new_store(spark, name):
    path = new_path(spark, name)
    return ResultStore(spark, path.rsplit("/", 1)[1].replace("-", "_"), path, int(spark.conf.get("spark.sql.shuffle.partitions"))).create()


def unfinished_in_store(spark, sf):
    tests = X.samples(spark, sf).where(F.col("split") == "test")
    store = new_store(spark, "finished")
    store.merge(X.earlier_results(tests).withColumn("run_hour", F.lit("20230829_09")), 0)
    return store.unfinished(tests).select("sample_id", "source", "template")


def picks(spark, sf):
    tests, pool = tests_and_pool(spark, sf)
    return SA.few_shot_picks(tests, pool, SHOTS, SEED)[0].select("sample_id", "i", "shot_id")


def few_shot(spark, sf, reasoned):
    tests, pool = tests_and_pool(spark, sf)
    chosen, _ = SA.few_shot_picks(tests, pool, SHOTS, SEED)
    if reasoned:
        prompt = P.inference_prompt(CHAT, F.lit("generic-3"))
        shot = P.reasoned_shot(prompt, reply(), F.col("output"))
    else:
        prompt, shot = P.inference_prompt(TOOLS), P.training_prompt(TOOLS)
    shots = SA.attach_shots(chosen, pool.select("sample_id", shot.alias("shot")))
    full = P.few_shot_prompt(tests.withColumn("prompt", prompt), shots)
    return with_prompt(full, F.col("few_shot_prompt"))


def reply():
    return F.concat(F.lit("Looking at "), "source", F.lit(" data.\n###Answer: unsure"))


def shots_only(spark, sf, reasoned):
    pool = external_model_rows(X.samples(spark, sf)).where(F.col("split") == "train")
    if reasoned:
        shot = P.reasoned_shot(P.inference_prompt(CHAT, F.lit("generic-3")), reply(), F.col("output"))
    else:
        shot = P.training_prompt(TOOLS)
    return with_prompt(pool, shot, "shot")


def messages(spark, sf):
    rows = X.samples(spark, sf).withColumn("prompt", P.inference_prompt(CHAT, F.lit("generic-3")))
    chat = rows.select("sample_id", P.chat_messages(CHAT, F.col("prompt"), reasoned=False).alias("m"))
    return chat.select(
        "sample_id", F.size("m").alias("messages"), F.get("m", F.lit(0))["role"].alias("first_role"),
        F.get("m", F.lit(0))["content"].alias("system"), F.get("m", F.lit(1))["role"].alias("second_role"),
        F.md5(F.get("m", F.lit(1))["content"]).alias("user_md5"),
    )


def hashed(prompt_sql, name="prompt"):
    return f"SELECT sample_id, length({name}) AS {name}_length, md5({name}) AS {name}_md5 FROM ({prompt_sql})"


EXTERNAL = """
tests AS (SELECT * FROM samples WHERE template <> 'template' AND source <> 'alpaca' AND split = 'test'),
pool AS (SELECT * FROM samples WHERE template <> 'template' AND source <> 'alpaca' AND split = 'train')"""


def draw(i):
    return HASH60.format(f"'{SEED}|' || sample_id || '|{i}'") + f" % (n - {SHOTS} + {i} + 1)"


PICKS = f"""{EXTERNAL},
ranked AS (SELECT source, template, sample_id AS shot_id,
    row_number() OVER (PARTITION BY source, template ORDER BY md5('{SEED}|' || sample_id)) - 1 AS rank,
    count(*) OVER (PARTITION BY source, template) AS n FROM pool),
sizes AS (SELECT source, template, count(*) AS n FROM pool GROUP BY ALL),
t AS (SELECT sample_id, source, template, n FROM tests JOIN sizes USING (source, template) WHERE n >= {SHOTS}),
d0 AS (SELECT *, {draw(0)} AS r0 FROM t),
d1 AS (SELECT *, CASE WHEN {draw(1)} = r0 THEN n - {SHOTS} + 1 ELSE {draw(1)} END AS r1 FROM d0),
d2 AS (SELECT *, CASE WHEN {draw(2)} IN (r0, r1) THEN n - {SHOTS} + 2 ELSE {draw(2)} END AS r2 FROM d1),
draws AS (SELECT sample_id, source, template, 1 AS i, r0 AS rank FROM d2
  UNION ALL SELECT sample_id, source, template, 2, r1 FROM d2 UNION ALL SELECT sample_id, source, template, 3, r2 FROM d2),
picks AS (SELECT sample_id, i, shot_id FROM draws JOIN ranked USING (source, template, rank))"""


def few_shot_sql(prompt, shot):
    return f"""{SAMPLES}, {PICKS},
      shots AS (SELECT sample_id, {shot} AS shot FROM pool),
      texts AS (SELECT p.sample_id, string_agg('Example ' || i || chr(10) || chr(10) || shot || chr(10) || chr(10), '' ORDER BY i) AS shot_text
                FROM picks p JOIN shots s ON s.sample_id = p.shot_id GROUP BY p.sample_id),
      full_prompts AS (SELECT sample_id, coalesce(shot_text || 'Now answer the following:' || chr(10) || chr(10), '') || prompt AS prompt
                FROM (SELECT *, {prompt} AS prompt FROM tests) LEFT JOIN texts USING (sample_id))
      {hashed('SELECT * FROM full_prompts')}"""


CHAT_PROMPT = inference_sql(CHAT, "'generic-3'")
REASONED = f"({CHAT_PROMPT}) || 'Looking at ' || source || ' data.' || chr(10) || '###Answer: ' || output"

UNFINISHED = f"""{SAMPLES}, t AS (SELECT * FROM samples WHERE split = 'test'), {results_sql('done', 'earlier', DONE, 't')}
            SELECT sample_id, source, template FROM t WHERE NOT EXISTS (SELECT 1 FROM done d
              WHERE d.source = t.source AND d.template = t.template AND d.instruction IS NOT DISTINCT FROM t.instruction
                AND d.input IS NOT DISTINCT FROM t.input AND d.data IS NOT DISTINCT FROM t.data)"""

QUERIES = {
    "c1_prompt_kind": (
        lambda spark, sf: X.samples(spark, sf).select("sample_id", P.prompt_kind().alias("prompt_kind")),
        f"{SAMPLES} SELECT sample_id, {KIND} AS prompt_kind FROM samples"),
    "c2_template_lookup": (
        template_lookup,
        f"""{SAMPLES} SELECT sample_id, prompt_kind, md5(CASE {" ".join(
            f"WHEN template = '{r}' AND prompt_kind = '{k}' THEN {lit(keys[k])}"
            for r, keys in TOOLS.items() for k in keys if k.endswith('_prompt'))} END) AS template_md5,
            CASE {" ".join(f"WHEN template = '{r}' AND prompt_kind = '{k}' THEN {lit(keys['response_split'])}"
            for r, keys in TOOLS.items() for k in keys if k.endswith('_prompt'))} END AS response_split
            FROM (SELECT *, {KIND} AS prompt_kind FROM samples)"""),
    "c3_inference_prompt": (
        lambda spark, sf: with_prompt(X.samples(spark, sf), P.inference_prompt(TOOLS)),
        f"{SAMPLES} {hashed(f'SELECT sample_id, {inference_sql(TOOLS)} AS prompt FROM samples')}"),
    "c4_training_prompt": (
        lambda spark, sf: with_prompt(X.samples(spark, sf), P.training_prompt(TOOLS)),
        f"{SAMPLES} {hashed(f'SELECT sample_id, {training_sql(TOOLS)} AS prompt FROM samples')}"),
    "c5_sectioned_text": (
        lambda spark, sf: with_prompt(X.samples(spark, sf), P.sectioned_text(), "text"),
        f"""{SAMPLES} {hashed('''SELECT sample_id, concat_ws(chr(10) || chr(10), '### Instruction:' || chr(10) || instruction,
            '### Input:' || chr(10) || input, '### Data:' || chr(10) || data, '### Response:' || chr(10) || output,
            '### Eval:' || chr(10) || derivation_eval, '### SQL:' || chr(10) || derivation_sql) AS text FROM samples''', 'text')}"""),
    "c6_few_shot_prompt": (
        lambda spark, sf: few_shot(spark, sf, True), few_shot_sql(CHAT_PROMPT, REASONED)),
    "c6_few_shot_plain": (
        lambda spark, sf: few_shot(spark, sf, False), few_shot_sql(inference_sql(TOOLS), training_sql(TOOLS))),
    "c7_reasoned_shot": (
        lambda spark, sf: shots_only(spark, sf, True),
        f"{SAMPLES}, {EXTERNAL} {hashed(f'SELECT sample_id, {REASONED} AS shot FROM pool', 'shot')}"),
    "c8_chat_messages": (
        messages,
        f"""{SAMPLES} SELECT sample_id, 2 AS messages, 'system' AS first_role,
            {lit(CHAT['generic-3']['system_message_default'])} AS system, 'user' AS second_role, md5({CHAT_PROMPT}) AS user_md5 FROM samples"""),
    "c9_plain_shot": (
        lambda spark, sf: shots_only(spark, sf, False),
        f"{SAMPLES}, {EXTERNAL} {hashed(f'SELECT sample_id, {training_sql(TOOLS)} AS shot FROM pool', 'shot')}"),
    "e1_without_finished": (
        unfinished,
        UNFINISHED),
    "e1_stored_results": (unfinished_in_store, UNFINISHED),
    "e2_few_shot_picks": (picks, f"{SAMPLES}, {PICKS} SELECT sample_id, i, shot_id FROM picks"),
}
