"""Growing replies, as a stream and in batch."""

from pyspark.sql import functions as F

from askgrid.functions.text import cut_between
from askgrid.schemas import TOKEN
from askgrid.session import new_path
from askgrid.sources import fixtures as X
from askgrid.streaming.progress import append_stream, file_stream
from askgrid.streaming.replies import growing_replies, prefixes
from askgrid.streaming.requests import INCOMPLETE, closed_replies, closing_replies
from catalog.base import HASH60, cut_sql

MARK = "### Response:"


def answers(df):
    return df.select("request_id", "pos", cut_between(F.col("output"), F.lit(MARK)).alias("result"))


def streamed(spark, sf):
    path, out, checkpoint = (new_path(spark, n) for n in ("tokens", "prefixes", "prefixes-state"))
    X.token_stream(spark, sf).repartitionByRange(4, "pos").write.parquet(path)
    append_stream(growing_replies(file_stream(spark, path, TOKEN, 2), keep_ms=None), out, checkpoint)
    return answers(spark.read.parquet(out))


def batch(spark, sf):
    return answers(prefixes(X.token_stream(spark, sf)))


def closing(df):
    return df.select("request_id", "pos", "status", "n_waiting", F.md5("output").alias("output_md5"))


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def closed_by_stream(spark, sf):
    """Tokens out of order over four files, then a row with a time alone, by which silent requests are closed."""
    path, out, checkpoint = (new_path(spark, n) for n in ("tokens", "closed", "closed-state"))
    tokens = X.sent_tokens(spark, sf)
    tokens.repartition(4, F.xxhash64("request_id", "pos")).write.parquet(path)
    later = F.timestamp_millis(F.lit(1_704_067_200_000 + 365 * 86_400_000))
    blank = {c: F.lit(None).cast(tokens.schema[c].dataType) for c in ("request_id", "pos", "token")}
    clock = spark.range(1).select(*[v.alias(c) for c, v in blank.items()], later.alias("sent_at"))
    clock.write.mode("append").parquet(path)
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        stream = closing_replies(file_stream(spark, path, tokens.schema, 2), "1 day", with_prefixes=False)
        append_stream(stream, out, checkpoint)
    finally:
        spark.conf.set(ROCKS[0], before)
    return closing(spark.read.parquet(out))


def closed_at_once(spark, sf):
    return closing(closed_replies(X.sent_tokens(spark, sf)))


def incomplete_requests(spark, sf):
    return closed_at_once(spark, sf).where(F.col("status") == INCOMPLETE)


SQL = f"""WITH words AS (SELECT conv_id || '-' || turn AS request_id, string_split('{MARK}' || chr(10) || text, ' ') AS w FROM conversations),
 tokens AS (SELECT request_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM words)
 SELECT request_id, CAST(pos AS INT) AS pos, {cut_sql('output', f"'{MARK}'")} AS result FROM (
   SELECT request_id, pos, string_agg(word, ' ') OVER (PARTITION BY request_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS output FROM tokens)"""

# A request's first lost position against that of its end mark; the two tokens after the mark count as places too.
CLOSED = f"""WITH words AS (SELECT conv_id || '-' || turn AS request_id, string_split('{MARK}' || chr(10) || text, ' ') AS w FROM conversations),
 places AS (SELECT request_id, w, unnest(range(len(w) + 3)) AS pos FROM words),
 kept AS (SELECT *, {HASH60.format("'lost|' || request_id || '|' || pos")} % 128 <> 0 AS came FROM places),
 firsts AS (SELECT request_id, any_value(w) AS w, min(pos) FILTER (NOT came) AS gap FROM kept GROUP BY request_id),
 ends AS (SELECT *, gap IS NULL OR gap > len(w) AS ended, least(coalesce(gap, len(w)), len(w)) AS stop FROM firsts),
 behind AS (SELECT request_id, count(*) FILTER (k.came AND k.pos > e.stop) AS n FROM kept k JOIN ends e USING (request_id) GROUP BY request_id),
 heard AS (SELECT request_id FROM kept WHERE came GROUP BY request_id)
 SELECT request_id, CAST(stop AS INT) AS pos, CASE WHEN ended THEN 'ended' ELSE 'incomplete' END AS status,
   CASE WHEN ended THEN 0 ELSE n END AS n_waiting, md5(array_to_string(w[1:stop], ' ')) AS output_md5
 FROM ends JOIN behind USING (request_id) JOIN heard USING (request_id)"""

QUERIES = {
    "i1_growing_replies": (streamed, SQL),
    "i1_closed_replies": (closed_by_stream, CLOSED),
    "i2_reply_prefixes": (batch, SQL),
    "i2_closed_replies": (closed_at_once, CLOSED),
    "i2_incomplete_requests": (incomplete_requests, f"SELECT * FROM ({CLOSED}) WHERE status = 'incomplete'"),
}
