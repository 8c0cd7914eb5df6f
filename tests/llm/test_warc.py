import datetime as dt
import gzip
import hashlib
import io
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

from gridpulse.llm import warc

SCHEMA = "page_id long, url string, captured long, html string, digest string, run string"


def test_loser_tree_merges_sorted_runs():
    rng = random.Random(1)
    for k in range(0, 18):
        runs = [sorted(rng.choices(range(9), k=rng.randint(0, 6))) for _ in range(k)]
        assert list(warc.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_records_round_trip():
    odd = "http://x.org/a%20b\r\nWARC-Type: fake"
    data = b""
    records = [(1, odd, 5, b"body \r\n\r\n more", False), (None, None, 0, b"", False), (3, "http://y/", 7, b"z" * 2000, True)]
    for page_id, url, captured, payload, revisit in records:
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        raw = warc.record(page_id, url, captured, payload, hashlib.sha1(payload).hexdigest(), len(payload), 9, revisit)
        data += z.compress(raw) + z.flush()
    got = list(warc.members(io.BytesIO(data), chunk=7))
    assert sum(n for _, n, _ in got) == len(data) and [o for o, _, _ in got] == [0, got[0][1], got[0][1] + got[1][1]]
    for (page_id, url, captured, payload, revisit), (_, _, raw) in zip(records, got, strict=True):
        row = warc.parse(raw)
        assert (row["page_id"], row["url"], row["captured"], row["payload_bytes"]) == (page_id, url, captured, len(payload))
        assert row["payload"] == (b"" if revisit else payload) and row["refers_to"] == (9 if revisit else None)


def test_damaged_payload_is_refused():
    raw = warc.record(1, "http://x/", 0, b"abc", hashlib.sha1(b"abd").hexdigest(), 3, None, False)
    try:
        warc.parse(raw)
        raise AssertionError
    except ValueError:
        pass


def test_capture_index_edges(spark):
    big = "é" * 600
    rows = [
        (1, "http://b.org/x", 3, big, "d", "r"), (2, "http://a.org/x", 2, big, "d", "r"), (9, "http://a.org/x", 1, big, "d", "r"),
        (9, "http://a.org/x", 1, big, "d", "r"), (None, None, None, big, "d", "r"), (4, "no scheme", 0, None, "d", "r"),
        (5, "http://a.org/x", 1, "", "d", "r"), (6, "http://a.org/x", 1, "small", "d", "r"), (7, "http://a.org/x", 1, "small", "d", "r"),
    ]
    out = warc.capture_index(spark.createDataFrame(rows, SCHEMA), min_bytes=1000).collect()
    assert len(out) == len(rows)
    for r in out:
        html = next(x[3] for x in rows if x[0] == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        revisit = r["page_id"] in (1, 2, None)
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (9 if revisit else None)
    order = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in out]
    assert order == sorted(order)
    assert warc.capture_index(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_ranges_and_archives_stay_in_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 7)
    pages = spark.range(200).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 3, F.lit(".org/")).alias("url"),
        (F.col("id") * 7 % 11).alias("captured"), F.repeat(F.lit("p"), (F.col("id") % 5 * 400).cast("int")).alias("html"),
    )
    out = [(r["url_key"], r["captured"], r["page_id"]) for r in warc.capture_index(pages.repartition(6), 1000).collect()]
    assert out == sorted(out) and len(out) == 200


def read_by_the_format(data):
    """Records of an archive by the grammar of WARC 1.1 alone: (fields, block) of each."""
    out = []
    for member in _members(data):
        head, _, rest = member.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        assert version == b"WARC/1.1"
        fields = {}
        for line in lines:
            m = re.fullmatch(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)", line)
            assert m and m[1] not in fields
            fields[m[1].decode()] = m[2].decode()
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
        dt.datetime.fromisoformat(fields["WARC-Date"])
        assert re.fullmatch(r"<urn:[a-z]+:[^>]*>", fields["WARC-Record-ID"])
        size = int(fields["Content-Length"])
        assert rest[size:] == b"\r\n\r\n"
        out.append((fields, rest[:size]))
    return out


def _members(data):
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        data = z.unused_data


def test_archives_follow_the_format(spark, scratch):
    folder = scratch("warc-format")
    long = "<p>very long</p>" * 250_000
    rows = [(1, "http://a.org/x", 1_577_836_800, "z" * 2000, "d", "r"), (2, "http://a.org/%zz\n", 0, "z" * 2000, "d", "r"), (3, None, -1, long, "d", "r"),
            (4, "http://b.org/", 10**15, "", "d", "r"), (5, "http://b.org/", -(10**15), None, "d", "r")]
    manifest = warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder).collect()
    records = []
    for m in manifest:
        with open("/" + m["path"].split(":", 1)[-1].lstrip("/"), "rb") as file:
            data = file.read()
        assert len(data) == m["bytes"] and len(gzip.decompress(data)) > 0
        records += read_by_the_format(data)
    by = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    assert len(records) == 5 and by["<urn:page:1>"][0]["WARC-Date"] == "2020-01-01T00:00:00Z"
    assert by["<urn:page:1>"][0]["WARC-Type"] == "revisit" and by["<urn:page:1>"][0]["WARC-Refers-To"] == "<urn:page:2>"
    assert by["<urn:page:3>"][1].partition(b"\r\n\r\n")[2] == long.encode() and by["<urn:page:3>"][0]["WARC-Date"] == "1969-12-31T23:59:59Z"
    assert by["<urn:page:4>"][0]["WARC-Date"][:4] == "9999" and by["<urn:page:5>"][0]["WARC-Date"][:4] == "0001"
    index = warc.capture_index(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["page_id"]: r["captured"] for r in index} == {r[0]: r[2] for r in rows}


def test_dates_of_other_writers_are_read():
    raw = warc.record(1, "http://x/", 0, b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None, False)
    raw = re.sub(rb"WARC-Date: [^\r]*\r\nCapture-Seconds: 0", b"WARC-Date: 2020-01-01T00:00:05.75Z", raw)
    assert warc.parse(raw)["captured"] == 1_577_836_805


def test_unknown_file_systems_are_refused(spark):
    with pytest.raises(ValueError, match="s3a://"):
        warc.capture_index(spark.createDataFrame([], SCHEMA), folder="s3a://bucket/warc")


def test_equal_captures_span_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 40)
    pages = spark.range(300).selectExpr("cast(null as long) page_id", "cast(null as string) url", "cast(null as long) captured", "string(id % 2) html")
    index = warc.capture_index(pages.repartition(4))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        sizes = [r["n"] for r in index.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set(key, old)
    assert sum(sizes) == 300 and max(sizes) <= 150
    got = [(r["run"], r["record_offset"]) for r in index.collect()]
    assert got == sorted(got) and len(set(got)) == 300
