import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc as W
from millrace.llm.common import file_system, new_dir

from .helpers import write_tables

SCHEMA = "page_id bigint, url string, html string"
ROWS = [(5, "http://a/x", "<p>same</p>"), (3, "http://b/\r\ny z", "<p>same</p>"), (9, None, None), (8, "http://c", ""), (7, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 50), (11, "u", "<p>same</p>")]


def brute(rows):
    out = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[page] = (len(raw), digest, "response" if page == first else "revisit", None if page == first else first)
    return out


def test_query_against_brute_force(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA).withColumn("key", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.op10(spark, write_tables(spark, tmp_path, pages=table)).collect()}
    assert got == brute(ROWS)


def test_selected_records_and_their_payloads(spark):
    index = W.write_archives(spark.createDataFrame(ROWS, SCHEMA), new_dir(spark, "warc-test"))
    got = {r.page_id: r for r in W.read_archives(index.filter("page_id in (7, 5)")).collect()}
    assert bytes(got[7].payload).decode() == ROWS[4][2] and got[5].record_type == "revisit" and bytes(got[5].payload) == b""
    assert set(got) == {5, 7}
    row = index.filter("page_id = 7").first()
    fs, path = file_system(row.file)
    with fs.open_input_file(path) as f:
        raw = gzip.decompress(f.read_at(row.length, row.offset))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")


def test_archives_are_plain_gzip_members(spark):
    index = W.write_archives(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), new_dir(spark, "warc-test"))
    total = 0
    for (file,) in index.select("file").distinct().collect():
        fs, path = file_system(file)
        with fs.open_input_file(path) as f:
            total += gzip.decompress(f.read()).count(b"WARC-Record-ID")
    assert total == len(ROWS)


def test_empty_table_nulls_and_least_bytes(spark):
    assert W.write_archives(spark.createDataFrame([], SCHEMA), new_dir(spark, "warc-test")).count() == 0
    index = W.write_archives(spark.createDataFrame([(None, "u", "x"), (4, "u", "x"), (4, "u", "x")], SCHEMA), new_dir(spark, "warc-test"))
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in W.read_archives(index).collect()) == [(0, "revisit", 4), (4, "response", None), (4, "response", None)]
    index = W.write_archives(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], SCHEMA), new_dir(spark, "warc-test"), least_bytes=2)
    assert {r.record_type for r in W.read_archives(index).collect()} == {"response"}


def test_ranges_are_joined():
    assert W.coalesced([(0, 10), (10, 5), (30, 5), (1000, 1)], gap=20, most=100) == [(0, 35, [(0, 10), (10, 5), (30, 5)]), (1000, 1, [(1000, 1)])]
    assert [r[:2] for r in W.coalesced([(0, 60), (60, 60)], gap=20, most=100)] == [(0, 60), (60, 60)]
    assert W.coalesced([]) == []


def test_a_common_payload_is_dealt_out(spark):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("html"))
    got = W.with_first(rows).filter("is_revisit")
    assert got.count() == 999 and got.select("first").distinct().collect()[0][0] == 0


def test_a_record_that_is_not_the_index_s_is_an_error(spark):
    index = W.write_archives(spark.createDataFrame(ROWS, SCHEMA), new_dir(spark, "warc-test"))
    wrong = index.withColumn("digest", F.when(F.col("page_id") == 7, "A" * 32).otherwise(F.col("digest")))
    assert W.read_archives(wrong.filter("page_id <> 7")).count() == len(ROWS) - 1
    with pytest.raises(Exception, match="the index names"):
        W.read_archives(wrong).collect()
