"""The registered queries of the pipeline operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm import (
    bpe, decontaminate, divergence, fingerprints, licenses, sharding, simhash, substrings, token_files, toxicity, urls, vector_codes, warc,
)
from askgrid.session import new_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id"]).withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
    })
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(_table(spark, folder, "pages"), path)
    read = warc.read_payloads(spark, path)
    return read.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        warc.page_of("refers_to").alias("refers_to"), "verified",
    )


URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge_urls(_table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", *[F.col(f"url_check.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "strict", "soft")])


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = _table(spark, folder, "documents").select("doc_id", licenses.scan_licenses().alias("s"))
    return found.select(
        "doc_id", "s.n_words", "s.n_base", "s.first_word", "s.last_word", F.array_join("s.base_labels", ",").alias("base_labels"),
        F.array_join("s.labels", ",").alias("labels"), "s.score",
    )


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_edited(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "tokens")
    shards = token_files.write_token_files(_table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.read_token_files(spark, path, shards).withColumnRenamed("id", "doc_id")


def op8_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, _table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, chain)
    return scored.select("doc_id", *[F.col(f"toxicity.{c}").alias(f"p_{c}") for c in toxicity.CHAIN], F.col("toxicity.rejected").alias("toxic"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op11_shards(spark: SparkSession, folder: str) -> DataFrame:
    data = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return sharding.shard_rows(_table(spark, folder, "documents").select("doc_id", "text"), 24).select(
        "row.doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows, books, at = vector_codes.compress_vectors(_table(spark, folder, "embeddings"))
    return vector_codes.with_label_error(rows).select(
        F.col("id").alias("vec_id"), vector_codes.code_text(F.col("code")).alias("code"), "error", "label_error",
        F.lit(vector_codes.books_digest(books[-1], at)).alias("codebooks_sha256"),
    )


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = r"regexp_extract_all({0}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
WORDS_OF = PLAIN_WORDS.format(LOWER.format("text"))

OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
n AS (SELECT payload_digest, max(page_id) AS newest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN newest <> page_id THEN newest END AS refers_to, TRUE AS verified
FROM d LEFT JOIN n USING (payload_digest)"""


def _term_sql(terms: list[str], url: str = "u") -> list[str]:
    return [f"regexp_matches({url}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in terms]


OP4_SQL = f"""
WITH a AS (SELECT page_id, {LOWER.format("url")} AS u, coalesce(url, '') AS url FROM pages),
b AS (
  SELECT page_id, u,
    {LOWER.format("CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1) END")} AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM a),
c AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
    CAST({" + ".join(rf"len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))" for t in urls.STRICT)} AS INT) AS strict,
    CAST({" + ".join(f"CAST({x} AS INT)" for x in _term_sql(urls.SOFT))} AS INT) AS soft
  FROM b)
SELECT page_id, host, path, rule, strict, soft,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN strict > 0 OR soft >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM c"""

# The templates as regular expressions over words with a blank on each side.
TEMPLATE_SQL = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under( a creative commons)? cc by 4 0",
    "cc-by-nc-4.0": "licensed under( a creative commons)? cc by nc 4 0",
    "gpl-3.0": "licensed under the gnu general public license( as published by the free software foundation)? version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "under the mit license",
}


def _op5_sql() -> str:
    places = " ".join(
        f"""UNION ALL SELECT doc_id, '{label}' AS label, i - 1 AS place
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE contains(line, ' {phrase} '))
        WHERE array_to_string(ws[i:i + {n - 1}], ' ') = '{phrase}'"""
        for phrase, label in licenses.PHRASES.items() for n in [len(phrase.split())]
    ).removeprefix("UNION ALL")
    full = " ".join(
        f"UNION ALL SELECT doc_id, '{label}' AS label FROM w WHERE regexp_matches(line, ' {pattern} ')" for label, pattern in TEMPLATE_SQL.items()
    ).removeprefix("UNION ALL")
    return f"""
WITH w AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM (SELECT doc_id, {WORDS_OF} AS ws FROM documents)),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
accepted AS ({full}),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM accepted) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN doc_id IN (SELECT doc_id FROM accepted) THEN 1.0::DOUBLE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN low USING (s), range(0, 13) r(k) WHERE first_doc < doc_id),
kept AS (
  SELECT doc_id, count(h.i) AS n_removed, string_agg(x, ' ' ORDER BY p.i) FILTER (h.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) p LEFT JOIN hit h USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_OF} AS ws FROM documents),
b AS (SELECT item_id, {WORDS_OF} AS ws FROM benchmark),
win AS (SELECT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS s
  FROM (SELECT item_id, ws, least(13, len(ws)) AS size, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)),
occ AS (SELECT DISTINCT doc_id, size, i, item_id FROM pos JOIN win USING (size, s)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), FALSE) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

def _op12_sql(rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (SELECT rn, x.p, any_value(y) AS y,
  CAST(min((list_dot_product(y, y) - 2 * list_dot_product(y, c) + list_dot_product(c, c)) * 256 + e) AS BIGINT) AS best
  FROM x JOIN book{r} b ON b.p = x.p GROUP BY rn, x.p)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, floor(sum(v) / count(*)) AS m
  FROM (SELECT p, best % 256 AS e, unnest(y) AS v, unnest(range(1, len(y) + 1)) AS i FROM near{r}) GROUP BY p, e, i) GROUP BY p, e),
book{r + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH q AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rn, vec_id, label, list_transform(embedding, lambda z: floor(1024 * CAST(z AS DOUBLE))) AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS (SELECT rn, p, list_slice(z, p * len(z) // 4 + 1, (p + 1) * len(z) // 4) AS y FROM q, range(4) t(p)),
book0 AS (SELECT p, rn AS e, y AS c FROM x WHERE rn < 256),{",".join(steps)},
codes AS (SELECT rn, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM near{rounds} GROUP BY rn),
digest AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS i FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM q JOIN codes USING (rn), digest"""


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT k, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n) AS size FROM n GROUP BY lang, source),
ln AS (SELECT lang, sum(n) AS size, count(DISTINCT term) AS v FROM n GROUP BY lang),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(gn.size, 0) + 5 * ln.v) AS p
  FROM g JOIN kept USING (lang) JOIN ln USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN n USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n.n) + 5)) // (any_value(ln.size) + 5 * any_value(ln.v)) AS q
  FROM n JOIN ln USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

QUERIES = {
    "op1_simhash": (op1_simhash, None),
    "op2_byte_bpe": (op2_byte_bpe, None),
    "op3_warc": (op3_warc, OP3_SQL),
    "op4_url_filter": (op4_url_filter, OP4_SQL),
    "op5_licenses": (op5_licenses, _op5_sql()),
    "op6_fingerprints": (op6_fingerprints, None),
    "op7_token_files": (op7_token_files, None),
    "op8_substrings": (op8_substrings, OP8_SQL),
    "op9_toxicity": (op9_toxicity, None),
    "op10_decontaminate": (op10_decontaminate, OP10_SQL),
    "op11_shards": (op11_shards, None),
    "op12_vector_codes": (op12_vector_codes, _op12_sql()),
    "op13_divergence": (op13_divergence, OP13_SQL),
}
