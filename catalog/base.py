"""SQL twins of the fixture views."""

from __future__ import annotations

from askgrid.operators.prompts import GENERIC_FIELDS, KIND_FIELDS, TRAINING_KINDS, segments
from askgrid.sources.templates import PROMPT_KINDS, load_templates

TOOLS = load_templates("tools")
CHAT = load_templates("chat")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HASH60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"

LINES = """
lines AS (SELECT *, CAST(l_quantity AS BIGINT) AS qty, 'sql-' || l_orderkey AS sample_id FROM lineitem),
order_tables AS (
  SELECT sample_id, l_orderkey,
    '{"header":["line","flag","quantity","price"],"rows":[' ||
    string_agg('["' || l_linenumber || '","' || l_returnflag || '","' || qty || '","' ||
               format('{:,.2f}', l_extendedprice) || '"]', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(qty AS VARCHAR), l_extendedprice) || ']' ||
    CASE WHEN l_orderkey % 2 = 0 THEN ',"types":["real","text","real","real"]' ELSE '' END || '}' AS data
  FROM lines GROUP BY sample_id, l_orderkey)"""

AGG = "list_extract(['MAX','MIN','COUNT','SUM','AVG'], CAST(l_orderkey % 5 AS INT) + 1)"

# The answers to the fixture questions, straight from the lines.
ANSWERS = f"""
answers AS (
  SELECT *, CASE agg WHEN 'COUNT' THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
                     ELSE coalesce(CAST(value AS VARCHAR), 'None') END AS result
  FROM (
    SELECT sample_id, l_orderkey, {AGG} AS agg,
      CASE {AGG} WHEN 'MAX' THEN max(q) WHEN 'MIN' THEN min(q) WHEN 'COUNT' THEN CAST(count(q) AS DOUBLE)
                 WHEN 'SUM' THEN sum(q) ELSE sum(q) / count(q) END AS value
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND (l_orderkey % 3 <> 0 OR l_quantity > 25)
                         THEN l_quantity END AS q FROM lines)
    GROUP BY sample_id, l_orderkey))"""

EQUATIONS = """
eq_lines AS (
  SELECT concat_ws('-', 'tat', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS sample_id,
    CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS a,
    l_quantity * 1000 AS b, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS shipped,
    (l_orderkey + l_linenumber) % 6 AS kind
  FROM lineitem),
equations AS (
  SELECT *,
    CASE kind
      WHEN 0 THEN '($' || format('{:,.2f}', a) || ' - $' || format('{:,.2f}', b) || ') / $' || format('{:,.2f}', b)
      WHEN 1 THEN '(' || format('{:.2f}', a) || ' + ' || format('{:.2f}', b) || ')/2'
      WHEN 2 THEN format('{:.2f}', a) || ' * ' || q
      WHEN 3 THEN q || ' * ' || n
      WHEN 4 THEN '$' || format('{:,.2f}', a) || ' / (' || n || ' - 1)'
      ELSE q || '% - ' || n || '%' END AS equation,
    CASE kind WHEN 3 THEN q * n WHEN 5 THEN q - n END AS whole,
    CASE kind
      WHEN 0 THEN CAST(format('{:.2f}', (a - b) / b * 100.0) AS DOUBLE)
      WHEN 1 THEN CAST(format('{:.2f}', (a + b) / 2.0) AS DOUBLE)
      WHEN 2 THEN CAST(format('{:.2f}', a * q) AS DOUBLE)
      WHEN 4 THEN CASE WHEN n <> 1 THEN CAST(format('{:.2f}', a / (n - 1)) AS DOUBLE) END END AS real_value
  FROM eq_lines),
eq_results AS (
  SELECT *, regexp_replace(equation, '[,%$]', '', 'g') AS eq_clean,
    coalesce(CAST(whole AS DOUBLE), real_value) AS value,
    CASE WHEN kind = 4 AND n = 1 THEN 'div_by_zero' ELSE 'ok' END AS status,
    coalesce(CAST(whole AS VARCHAR), CAST(real_value AS VARCHAR),
      'Equation is malformed: ' || regexp_replace(equation, '[,%$]', '', 'g') || chr(10) || 'Exception:division by zero') AS result
  FROM equations)"""

QUESTION_JSON = f"""'{{"agg":"' || {AGG} || '","pick":"quantity","conds":[{{"col":"flag","op":"=","val":"R"}}' ||
      CASE WHEN l_orderkey % 3 = 0 THEN ',{{"col":"quantity","op":">","val":"25"}}' ELSE '' END ||
      '],"descending":false,"is_distinct":false}}'"""

TEXTS = """
chats AS (
  SELECT 'alp-' || u.conv_id || '-' || u.turn AS sample_id, u.text AS instruction, '' AS input, '' AS data,
    'generic' AS template, 'alpaca' AS source, '' AS derivation_eval, '' AS derivation_sql, a.text AS output
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
sentiments AS (
  SELECT 'sen-' || doc_id AS sample_id, 'What is the sentiment of this text?' AS instruction, text AS input, '' AS data,
    'generic' AS template, 'phrase-bank' AS source, '' AS derivation_eval, '' AS derivation_sql,
    CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS output
  FROM documents JOIN labels USING (doc_id)),
passages AS (
  SELECT 'ott-' || doc_id AS sample_id, 'What is the order status?' AS instruction, text AS input,
    '{"header":["status","total","priority","date"],"rows":[["' || o_orderstatus || '","' ||
    format('{:,.2f}', o_totalprice) || '","' || o_orderpriority || '","' || strftime(o_orderdate, '%Y-%m-%d') ||
    '"]],"types":["text","real","text","text"]}' AS data,
    'table' AS template, 'ott-qa' AS source, '' AS derivation_eval, '' AS derivation_sql, o_orderstatus AS output
  FROM documents JOIN orders ON o_orderkey = doc_id),
raw_texts AS (
  SELECT * FROM chats UNION ALL SELECT * FROM sentiments UNION ALL SELECT * FROM passages
  UNION ALL SELECT * REPLACE ('route-' || sample_id AS sample_id, template AS output, 'template' AS template) FROM chats
  UNION ALL SELECT * REPLACE ('route-' || sample_id AS sample_id, template AS output, 'template' AS template) FROM passages)"""

RAW_SAMPLES = f"""
raw_samples AS (
  SELECT * FROM raw_texts
  UNION ALL
  SELECT sample_id, 'What is the ' || {AGG} || ' of quantity where the flag is R' ||
      CASE WHEN l_orderkey % 3 = 0 THEN ' and the quantity is above 25' ELSE '' END || '?', '', data,
    'script', 'wiki-sql', '', {QUESTION_JSON}, 'order ' || l_orderkey
  FROM order_tables
  UNION ALL
  SELECT sample_id, 'Work out figure ' || kind || ' for line ' || n || '.',
    CASE WHEN n % 2 = 0 THEN 'The line has status ' || l_linestatus || ' and was shipped on ' || shipped || '.' ELSE '' END,
    '{{"header":["quantity","price"],"rows":[["' || q || '","' || format('{{:,.2f}}', a) || '"]],"types":["real","real"]}}',
    'arithmetic', 'tat-qa', equation, '', CASE WHEN status = 'ok' THEN result ELSE 'n/a' END
  FROM eq_results)"""


def _finish(source: str, name: str) -> str:
    nulls = ", ".join(
        f"nullif({c}, '') AS {c}"
        for c in ("sample_id", "instruction", "input", "data", "template", "source", "derivation_eval", "derivation_sql", "output")
    )
    digit = "substr(md5('split|' || sample_id), 1, 1)"
    return f"""
{name} AS (
  SELECT {nulls},
    CASE WHEN {digit} IN ('0', '1') THEN 'test' WHEN {digit} = '2' THEN 'val' ELSE 'train' END AS split
  FROM {source})"""


SAMPLES = "WITH " + ",".join([LINES, EQUATIONS, TEXTS, RAW_SAMPLES, _finish("raw_samples", "samples")])

KIND = """CASE WHEN input IS NOT NULL AND data IS NOT NULL THEN 'full_prompt' WHEN data IS NOT NULL THEN 'data_prompt'
  WHEN input IS NOT NULL THEN 'input_prompt' ELSE 'default_prompt' END"""


def filled(text: str) -> str:
    parts = []
    for literal, field in segments(text):
        if literal:
            parts.append(lit(literal))
        if field:
            parts.append(f"coalesce({field}, '')")
    return " || ".join(parts)


def inference_sql(templates: dict, route: str = "template") -> str:
    whens = [
        f"WHEN {route} = '{r}' AND {KIND} = '{k}' THEN {filled(keys[k])}"
        for r, keys in templates.items() for k in PROMPT_KINDS if k in keys
    ]
    return "CASE " + "\n ".join(whens) + " END"


def training_sql(templates: dict, use_tools: bool = True) -> str:
    whens = []
    for r, kinds in TRAINING_KINDS.items():
        for k in kinds:
            if k not in templates.get(r, {}):
                continue
            allowed = GENERIC_FIELDS[k] if r == "generic" else KIND_FIELDS[k]
            if {f for _, f in segments(templates[r][k]) if f} <= set(allowed):
                whens.append(f"WHEN template = '{r}' AND {KIND} = '{k}' THEN {filled(templates[r][k])}")
    target = "output"
    if use_tools:
        target = "CASE template WHEN 'script' THEN derivation_sql WHEN 'arithmetic' THEN derivation_eval ELSE output END"
    return "(CASE " + "\n ".join(whens) + f" END) || {target}"


def separator_sql(templates: dict, route: str = "template") -> str:
    return f"CASE {route} " + " ".join(f"WHEN '{r}' THEN {lit(k['response_split'])}" for r, k in templates.items()) + " END"


SPACE = r"chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)" + "".join(f"||chr({c})" for c in range(8192, 8203))


def cut_sql(text: str, sep: str) -> str:
    return f"CASE WHEN contains({text}, {sep}) THEN trim(replace(split_part({text}, {sep}, 2), '</s>', ''), {SPACE}) END"


GOLD = "coalesce(CASE template WHEN 'script' THEN derivation_sql WHEN 'arithmetic' THEN derivation_eval ELSE output END, '')"
ANSWER_OUT = f"""
answer_out AS (
  SELECT *, CASE substr(md5('answer|' || sample_id), 1, 1)
      WHEN 'f' THEN NULL WHEN 'e' THEN prompt || 'no answer' WHEN 'd' THEN gold
      WHEN 'c' THEN prompt || gold || sep || 'again</s>' WHEN 'b' THEN prompt || '  ' || chr(10) || gold || ' ' || chr(10) || '</s>'
      ELSE prompt || gold || '</s>' END AS raw_output
  FROM (SELECT *, '<s> ' || {inference_sql(TOOLS)} AS prompt, {GOLD} AS gold, {separator_sql(TOOLS)} AS sep FROM samples))"""
ROUTE_OUT = f"""
route_out AS (
  SELECT *, CASE substr(md5('route|' || sample_id), 1, 1)
      WHEN 'f' THEN own WHEN 'e' THEN prompt || 'equation</s>' WHEN 'd' THEN prompt || 'table</s>'
      ELSE prompt || own || '</s>' END AS raw_output
  FROM (SELECT *, '<s> ' || {inference_sql(TOOLS, "'template'")} AS prompt,
               CASE WHEN template = 'template' THEN 'generic' ELSE template END AS own FROM samples))"""


def results_sql(name: str, variant: str, where: str = "TRUE", source: str = "samples") -> str:
    digit = f"substr(md5('{variant}|' || sample_id), 1, 1)"
    return f"""
{name} AS (
  SELECT source, template, instruction, input, data, output AS gold, coalesce(derivation_eval, derivation_sql) AS gold_eval,
    CASE WHEN {digit} < '8' THEN output WHEN {digit} = '8' THEN ' ' || CASE WHEN source = 'phrase-bank' THEN upper(output) ELSE output END || chr(10)
         WHEN {digit} = '9' THEN output || '%' WHEN {digit} = 'a' THEN '$' || output ELSE 'wrong' END AS pred,
    coalesce(derivation_eval, derivation_sql) AS pred_eval
  FROM {source} WHERE {where})"""


DONE = "substr(md5('done|' || sample_id), 1, 1) < '8'"
PIECES = r"regexp_extract_all({0}, '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}\s]')"
COUNT = r"(coalesce(len(regexp_extract_all({0}, '\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}\s]')), 0) + 1)"
