from __future__ import annotations

import hashlib

from helixframe.llm import queries, warc
from helixframe.llm.common import fresh_path
from tests.oracle import same

BIG = "<p>" + "é" * 600 + "</p>"


def pages(spark):
    rows = [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (9, "http://a/9", BIG), (3, "http://a/3", "small"),
        (4, "http://a/4", "small"), (5, "http://a/5", None), (6, "http://a/6", ""), (None, "http://a/null", "small"),
        (7, "http://a/7\r\nWARC-Type: forged", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
        (8, "http://a/8", "y" * 999), (10, "http://a/10", "y" * 999), (11, "http://a/11", "z" * 1000), (12, "http://a/12", "z" * 1000),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def test_query_matches_sql(spark, medium):
    same(queries.op2_warc(spark, medium), queries.SQL["op2_warc"], medium)


def test_types_and_payloads(spark):
    frame, rows = pages(spark)
    got = warc.archive_and_read(frame).collect()
    assert len(got) == len(rows)
    kinds = {}
    for r in got:
        kinds.setdefault(r.page_id, set()).add((r.record_type, r.refers_to))
    assert kinds[1] == kinds[2] == {("revisit", 9)} and kinds[9] == {("response", None)}
    assert kinds[11] == {("revisit", 12)} and kinds[12] == kinds[8] == kinds[10] == kinds[None] == {("response", None)}
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha1(html[r.page_id]).hexdigest())
        assert r.header_digest == r.payload_digest
    assert {r.url for r in got if r.page_id == 7} == {"http://a/7%0D%0AWARC-Type: forged"}


def test_payloads_are_stored_once(spark):
    frame, _ = pages(spark)
    path = warc.write_archive(frame, fresh_path(spark, "test-warc"))
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert len(stored) == len({bytes(r.payload) for r in stored}) == 6
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.sha256 for r in stored)


def test_exact_round_trip_through_files(spark):
    frame, rows = pages(spark)
    path = warc.write_archive(frame, fresh_path(spark, "test-warc"))
    original = sorted(bytes(r.record) for r in warc.original_records(spark, path).collect())
    warc.export_warc(spark, path, f"{path}/files", per_file=3)
    read = warc.import_warc(spark, f"{path}/files").collect()
    assert sorted(bytes(r.header) + bytes(r.block) + b"\r\n\r\n" for r in read) == original
    assert len(read) == len(rows)
    whole = {r.page_id: bytes(r.payload) for r in warc.original_records(spark, path).collect()}
    assert all(whole[i] == (h or "").encode() for i, _, h in rows)  # revisits too


def test_a_changed_payload_is_an_error(spark):
    import pytest
    from pyspark.sql import functions as F

    frame, _ = pages(spark)
    path = warc.write_archive(frame, fresh_path(spark, "test-warc"))
    forged = fresh_path(spark, "test-warc")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{forged}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{forged}/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(spark, forged).collect()


def test_empty_and_hot(spark):
    frame, _ = pages(spark)
    assert warc.archive_and_read(frame.limit(0)).count() == 0
    hot = spark.range(6000).selectExpr("id as page_id", "'http://h' as url", "case when id % 3 = 0 then repeat('h', 2000) else concat(repeat('x', 1000), id) end as html")
    got = warc.archive_and_read(hot)
    assert got.filter("record_type = 'revisit' and refers_to = 5997").count() == 1999
    assert got.filter("record_type = 'response'").count() == 4001
