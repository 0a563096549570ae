import gzip
import hashlib
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panmixia.llm import warc


def expected(rows):
    first = {}
    for r in rows:
        h = r["html"] or ""
        if len(h.encode()) >= 100 and r["page_id"] is not None:
            first[h] = min(first.get(h, r["page_id"]), r["page_id"])
    out = Counter()
    for r in rows:
        raw = (r["html"] or "").encode()
        again = r["html"] in first and r["page_id"] != first[r["html"]]
        out[(r["page_id"], len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[r["html"]] if again else None)] += 1
    return out


def told(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y%20", big), (3, "http://b/", big), (7, None, "x" * 99), (8, None, "x" * 99), (9, "u", None), (10, "u", ""), (None, "u", big), (11, "u", "WARC/1.1\r\n\r\n" * 30), (12, "u", "long " * 300_000)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, first string")


def test_round_trip(pages):
    assert told(warc.round_trip(pages)) == expected(pages.collect())


def test_test_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert told(warc.round_trip(table)) == expected(table.collect())


def test_a_payload_unlike_its_header_fails(spark, monkeypatch):
    def damaged(pages, uri):
        warc.register(pages.sparkSession)
        digest = F.sha2(F.col("html").cast("binary"), 256)
        rows = pages.select("page_id", "url", F.expr("substr(html, 2)").alias("html"), digest.alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
        rows.write.format("warc").mode("append").option("path", uri).save()

    monkeypatch.setattr(warc, "write_pages", damaged)
    with pytest.raises(Exception, match="payload and header differ"):
        warc.round_trip(spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string")).collect()


def test_shuffle_join_beyond_the_bound(pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert told(warc.round_trip(pages)) == expected(pages.collect())


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_filters_and_plain_files(spark, pages, tmp_path, compression):
    warc.register(spark)
    warc.write_pages(pages, f"{tmp_path}/a")
    rows = warc.read(spark, f"{tmp_path}/a").where(F.col("record_type") == "response").collect()
    for r in rows:
        assert hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"]
    one = warc.read(spark, f"{tmp_path}/a").where(F.col("page_id").isin(5, 11)).select("page_id", "record_type", "payload").collect()
    assert {(r["page_id"], r["record_type"], r["payload"] is None) for r in one} == {(5, "revisit", True), (11, "response", False)}
    urls = {r["target_uri"] for r in rows}
    assert "http://b/\r\nX: y%20" in urls
    assert warc.read(spark, f"{tmp_path}/a", recordTypes="revisit").count() == 1 + 1  # page 5 and the page without an id


def test_other_writers_archives(spark, tmp_path):
    """Members without skip lengths, several records, a header with a continuation of case."""
    def record(kind, body):
        return f"WARC/1.0\r\nwarc-type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    Path(tmp_path, "b.warc.gz").write_bytes(b"".join(gzip.compress(record(k, b)) for k, b in (("warcinfo", b"i" * 70_000), ("response", b"HTTP/1.1 200 OK\r\n\r\nhello"), ("resource", b"raw"))))
    Path(tmp_path, "c.warc").write_bytes(record("resource", b"one") + record("resource", b"two"))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert Counter(r["record_type"] for r in rows) == {"warcinfo": 1, "response": 1, "resource": 3}
    assert {bytes(r["payload"]) for r in warc.read(spark, str(tmp_path), recordTypes="resource").collect()} == {b"raw", b"one", b"two"}


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_are_read_in_stretches(spark, pages, tmp_path, compression):
    """A partition a record or two, and the headers that the format asks for."""
    warc.write_pages(pages.coalesce(1), f"{tmp_path}/s", splitBytes=1, compression=compression, date="2024-02-03T04:05:06Z")
    warc.register(spark)
    rows = warc.read(spark, f"{tmp_path}/s")
    assert rows.rdd.getNumPartitions() == rows.count() == pages.count()
    assert {r["payload_digest"] for r in rows.collect()} == {hashlib.sha256((r["html"] or "").encode()).hexdigest() for r in pages.collect()}
    raw = b"".join((gzip.decompress if compression == "gzip" else bytes)(p.read_bytes()) for p in Path(f"{tmp_path}/s").glob("*.warc*"))
    heads = [dict(line.split(": ", 1) for line in h.decode().split("\r\n")[1:]) for h in re.findall(rb"WARC/1\.1\r\nWARC-Type.*?(?=\r\n\r\n)", raw, re.S)]
    assert len(heads) == pages.count() and {h["WARC-Date"] for h in heads} == {"2024-02-03T04:05:06Z"}
    ids = {h["WARC-Record-ID"]: h for h in heads}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert revisits and all(ids[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] for h in revisits)


def test_empty(spark, pages):
    assert warc.round_trip(pages.where(F.lit(False))).count() == 0
