import hashlib

from askgrid.llm import warc


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "WARC/1.1\r\n\r\nWARC/1.1\r\n" * 9000 + "é" * 70_000
    same = "z" * 1000
    pages = [(1, "http://a/ b\r\nX: y", same), (7, None, same), (3, "u", same), (4, "u", "s" * 999), (5, "u", "s" * 999), (6, "u", None), (8, "u", ""), (9, "u", big), (10, "u", big), (11, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", same), (None, "u", "alone" * 400), (9, "u", big), (12, "u", "0\r\n\r\n" * 500)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, pages_per_archive=3)
    found = warc.read_payloads(spark, path).withColumn("page", warc.page_of("record_id")).withColumn("of", warc.page_of("refers_to")).collect()
    newest = {same: 7, big: 10}
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        n = newest.get(html)
        again = n is not None and n != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", n if again else None, True))
    assert sorted(((r["page"], r["payload_bytes"], r["digest"], r["record_type"], r["of"], r["verified"]) for r in found), key=str) == sorted(want, key=str)
    kept = {r["page"]: bytes(r["payload"]).decode() for r in found if r["payload"] is not None and r["page"]}
    assert all(kept[i] == (h or "") for i, _, h in pages if i in kept)
    assert warc.read_records(spark, path).where("record_type = 'continuation'").count() >= 10


def test_missing_and_repeated_segments(spark):
    block = warc.HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc" * 100)
    digest = hashlib.sha1(b"abc" * 100).hexdigest()
    parts = [warc.parsed(r) for r in warc.records(5, "u", b"abc" * 100, digest, None, "d", 100)]
    assert len(parts) > 3 and b"".join(p["block"] for p in parts) == block
    for kept, whole in ((parts, True), (parts[::-1] + parts[1:2], True), (parts[:-1], False), (parts[:1] + parts[2:], False)):
        (got,) = warc.reassembled(spark.createDataFrame([tuple(p.values()) for p in kept], warc.PARSED_DDL)).collect()
        assert got["whole"] == whole and (not whole or bytes(got["block"]) == block)


def test_framing():
    for data in (b"", b"x", b"\r\n" * 50, bytes(range(256)) * 99):
        assert warc.dechunked(warc.chunked(data, 7)) == data
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"zz\r\n") is None
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    assert warc.parsed(b"junk") is None


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_payloads(spark, str(tmp_path / "e")).count() == 0
