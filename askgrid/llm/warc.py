"""WARC archives: writing, reading, and putting segmented records together again.

Archives are files of records, each a header and a block with its length. Blocks are
HTTP messages whose bodies are in chunked transfer framing. A block above the segment
size is cut: the first segment is the record itself, the others are continuation
records that name it as their origin, with their number; the last one has the total
length. Spark's text reader cuts archives at the end of each record, so they may be
compressed and need no other file access.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm.common import written

VERSION = b"WARC/1.1"
#: Two line ends close a record, and the next one begins.
BETWEEN = "\r\n\r\n"
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Smallest payload that a revisit record may stand for.
REVISIT_BYTES = 1000
#: Parts into which the rows of one payload are split where they are joined.
SALTS = 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked framing; no chunk contains the version line whole."""
    cuts, at = {0, len(payload)}, -1
    cuts.update(range(0, len(payload), size))
    while (at := payload.find(VERSION, at + 1)) >= 0:
        cuts.add(at + 2)
    edges = sorted(cuts)
    parts = [b"%x\r\n%b\r\n" % (e - s, payload[s:e]) for s, e in zip(edges, edges[1:])]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        at = end + 2 + size
        if body[at:at + 2] != b"\r\n":
            return None
        out.append(body[end + 2:at])
        at += 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head.encode("utf-8") + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(text: str | None) -> str:
    """A target without blanks and line ends, which would end the field."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "urn:none")


def records(page_id, url, html: bytes, digest: str, refers_to, date: str, segment_bytes: int) -> list[bytes]:
    """The record of a page, or the records of its segments."""
    own = f"<urn:page:{page_id}:{digest}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")]
        return [_record(fields, HTTP + b"\r\n")]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(html)
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    cuts = range(0, len(block), segment_bytes)
    out = [_record([*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for number, s in enumerate(cuts[1:], 2):
        part = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{digest}:{number}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
        if number == len(cuts):
            part.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(part, block[s:s + segment_bytes]))
    return out


def _salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    """One row for each salt."""
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
    date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES,
    pages_per_archive: int = 20_000,
) -> None:
    """Write one record per row to compressed archives below ``path``.

    Of the rows with one payload of at least ``revisit_bytes`` bytes the one with the
    largest id is a response, and the others are revisits of it without a body; the other
    rows are responses. Null html is an empty payload, a null URL ``urn:none``. A null id
    is never the largest; equal payloads whose ids are all null, and rows that repeat the
    largest id, are all responses.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = rows.where(F.octet_length("html") >= revisit_bytes)
    newest = large.groupBy("digest").agg(F.max("order").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A payload that a third of all rows share is met by SALTS tasks.
    joined = rows.withColumn("salt", _salt("id")).join(newest.withColumn("salt", _salts()), ["digest", "salt"], "left")
    refers = F.when(~F.col("order").eqNullSafe(F.col("newest")), F.col("newest").cast("string"))

    def lay(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(k, 500).to_pylist():
                    out += records(r["id"], r["url"], r["html"], r["digest"], r["refers_to"], date, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    laid = joined.select("id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(lay, "value binary")
    laid.select(F.col("value").cast("string")).write.option("lineSep", BETWEEN).option("compression", "gzip").option(
        "maxRecordsPerFile", pages_per_archive
    ).text(path)


PARSED = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()),
    ("origin_id", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("whole", pa.bool_()), ("block", pa.binary()),
])
PARSED_DDL = (
    "record_id string, record_type string, target_uri string, digest string, refers_to string,"
    " origin_id string, number int, total long, whole boolean, block binary"
)
#: What a record's payload adds to it.
PAYLOAD = pa.schema([("payload", pa.binary()), ("sha1", pa.string()), ("size", pa.int64())])
PAYLOAD_DDL = "payload binary, sha1 string, size long"
READ = pa.schema([*PARSED, *PAYLOAD])
#: A record after its segments are put together.
WHOLE = pa.schema([*[PARSED.field(c) for c in ("record_id", "record_type", "target_uri", "digest", "refers_to", "whole")], *PAYLOAD])
WHOLE_DDL = f"record_id string, record_type string, target_uri string, digest string, refers_to string, whole boolean, {PAYLOAD_DDL}"


def parsed(data: bytes) -> dict | None:
    """The fields and the block of a record; None if it isn't one."""
    data = data.removeprefix(VERSION + b"\r\n")
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        return None
    number, total = (fields.get(f"warc-segment-{k}", "") for k in ("number", "total-length"))
    return {
        "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None, "refers_to": fields.get("warc-refers-to"),
        "origin_id": fields.get("warc-segment-origin-id"), "number": int(number) if number.isdigit() else None,
        "total": int(total) if total.isdigit() else None, "whole": len(rest) >= int(size), "block": rest[:int(size)],
    }


def payload_of(block: bytes) -> bytes | None:
    """The body of an HTTP message, out of its chunked framing if it has one."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    lines = [line.replace(b" ", b"").lower() for line in head.split(b"\r\n")]
    return dechunked(body) if b"transfer-encoding:chunked" in lines else body


def decoded(record_type: str | None, block: bytes) -> dict:
    """The payload in a whole block, its SHA-1 and its size; nulls for revisits and broken framing."""
    payload = None if record_type == "revisit" else payload_of(block)
    if payload is None:
        return {"payload": None, "sha1": None, "size": None}
    return {"payload": payload, "sha1": hashlib.sha1(payload).hexdigest(), "size": len(payload)}


def read_records(spark: SparkSession, path: str, all_blocks: bool = True) -> DataFrame:
    """Every record of the archives below ``path`` as ``READ``; other pieces are left out.

    Records that are not segments come with their payload, its SHA-1 and its size; without
    ``all_blocks`` only segments keep their block.
    """
    pieces = spark.read.option("lineSep", BETWEEN + VERSION.decode() + "\r\n").text(path)

    def parse(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                found = [x for x in map(parsed, batch.column("value").slice(k, 500).to_pylist()) if x]
                for record in found:
                    if record["number"] is None:
                        record |= decoded(record["record_type"], record["block"])
                        if not all_blocks:
                            record["block"] = None
                yield pa.RecordBatch.from_pylist(found, schema=READ)

    return pieces.select(F.col("value").cast("binary")).mapInArrow(parse, f"{PARSED_DDL}, {PAYLOAD_DDL}")


def reassembled(found: DataFrame) -> DataFrame:
    """Segmented records put together: segments in order behind the record they continue.

    ``whole`` says whether nothing is missing: every segment has its length, the numbers
    run from 1 without a gap, and the lengths add up to the total. Repeated segments
    count once. The segments of one record meet in one task; a record is the bound.
    """
    first = found.where("number = 1").select("record_id", "record_type", "target_uri", "digest", "refers_to", F.col("whole").alias("own"), F.col("block").alias("head"))
    later = found.where("number > 1").groupBy(F.col("origin_id").alias("record_id")).agg(
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"), F.min("whole").alias("parts_whole"), F.max("total").alias("total")
    )
    joined = first.join(later, "record_id", "left")
    block = F.aggregate("parts", F.col("head"), lambda a, p: F.concat(a, p["block"]))
    ordered = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(2), F.size("parts") + 1)
    return joined.withColumn("block", F.coalesce(block, "head")).select(
        "record_id", "record_type", "target_uri", "digest", "refers_to",
        F.coalesce(F.col("own") & F.col("parts_whole") & ordered & (F.octet_length("block") == F.col("total")), F.lit(False)).alias("whole"), "block",
    )

def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, record_type, target_uri, refers_to, digest, payload, payload_bytes, verified`` per record.

    ``payload`` is out of its framing and null for revisits, whose ``payload_bytes`` are
    those of the record that they refer to. ``verified``: whole, and of the digest that
    the header has (a revisit: that of the record it refers to).
    """
    found = written(read_records(spark, path, all_blocks=False), "warc-records")

    def decode(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500).to_pylist()
                yield pa.RecordBatch.from_pylist([r | decoded(r["record_type"], r["block"]) for r in part], schema=WHOLE)

    put = reassembled(found).mapInArrow(decode, WHOLE_DDL)
    read = found.where("number is null").select(put.columns).unionByName(put)
    seen = F.coalesce(F.col("whole") & (F.col("sha1") == F.col("digest")), F.lit(False))
    own = read.where("refers_to is null").select(
        "record_id", "record_type", "target_uri", "refers_to", "digest", "payload", F.col("size").alias("payload_bytes"), seen.alias("verified"),
    )
    # Revisits have no body. Of the responses only those that some revisit names are laid out for every salt.
    again = read.where("refers_to is not null").drop("payload", "sha1", "size")
    named = again.select(F.col("refers_to").alias("record_id")).distinct()
    first = (
        read.where("record_type = 'response'").select("record_id", "size", "sha1").join(named, "record_id", "left_semi")
        .groupBy(F.col("record_id").alias("refers_to")).agg(F.max("size").alias("size"), F.max("sha1").alias("sha1")).withColumn("salt", _salts())
    )
    revisits = again.withColumn("salt", _salt("record_id")).join(first, ["refers_to", "salt"], "left").select(
        "record_id", "record_type", "target_uri", "refers_to", "digest", F.lit(None).cast("binary").alias("payload"),
        F.col("size").alias("payload_bytes"), seen.alias("verified"),
    )
    return own.unionByName(revisits)


def page_of(record_id: str):
    """The page id inside a record id; null if there is none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:([^:>]*):", 1), F.lit("")).try_cast("long")
