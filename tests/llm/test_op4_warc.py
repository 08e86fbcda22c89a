import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from sheetloom.llm import queries, warc
from sheetloom.llm.storage import new_path

SCHEMA = "page_id long, url string, html string, record long, sha1 string, n_bytes long"


def check(rows, pages, min_bytes=0):
    first = {}
    for page_id, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(html or "", page_id)
    groups = {}
    for _, html in pages:
        groups[html or ""] = groups.get(html or "", 0) + 1
    want = []
    for page_id, html in pages:
        data = (html or "").encode()
        refers = first.get(html or "") if groups[html or ""] > 1 and len(data) >= min_bytes and first.get(html or "") != page_id else None
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_query(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    check(queries.op4_warc_chunks(spark, sf_dir).collect(), pages)


ODD = [(1, "u", "same"), (2, "http://x/\r\nX: y", "same"), (3, None, "same"), (None, None, "same"), (None, None, None), (4, "u", ""), (5, "u", ""), (6, "u", "é" * 40_000), (7, "u", "é" * 40_000), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "z" * 30_000), (9, "u", "z" * 30_000), (-1, "u", "y")]


def test_odd_rows_in_small_chunks(spark):
    pages = spark.createDataFrame([(*r, 1, "s", 2) for r in ODD], SCHEMA).repartition(3)
    for chunk, least in ((7, 0), (1000, 5), (1 << 20, 0)):
        path = new_path(spark, "w")
        warc.write_records(pages, path, min_bytes=least, chunk_bytes=chunk)
        records = warc.read_records(spark, path).collect()
        assert all(r.intact for r in records)
        check([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records], [(a, c) for a, _, c in ODD], least)
        ids = {r.record_id for r in records}
        assert all(i.startswith("urn:uuid:") for i in ids)
    path = new_path(spark, "w")
    warc.write_records(pages.limit(0), path)
    assert warc.read_records(spark, path).count() == 0


def test_headers_of_any_length(spark):
    pages = spark.createDataFrame([(1, "u" * 3_000_000, "k" * 500, 1, "s", 2), (2, "v" * 1_500_000, "m" * 3_000_000, 1, "s", 2)], SCHEMA)
    path = new_path(spark, "w")
    warc.write_records(pages, path)
    rows = {r.page_id: r for r in warc.read_records(spark, path).collect()}
    assert {i: (r.payload_bytes, r.intact, len(r.target_uri)) for i, r in rows.items()} == {1: (500, True, 3_000_000), 2: (3_000_000, True, 1_500_000)}


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_half_the_pages_repeat_others(spark, threshold):
    """Both ways of joining the first copies: by shuffle and by broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = [(i, f"http://x/{i}", f"page {i % 150} " + "<p>text</p>" * (i % 150)) for i in range(300)] + [(1000 + i, "u", "hot page") for i in range(150)]
        path = new_path(spark, "w")
        warc.write_records(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], SCHEMA).repartition(4), path)
        records = warc.read_records(spark, path).collect()
        check([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records], [(a, c) for a, _, c in rows])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "k" * 500, 1, "s", 2), (2, "u", "m" * 500, 1, "s", 2)], SCHEMA).coalesce(1)
    path, hurt = new_path(spark, "w"), new_path(spark, "w")
    warc.write_records(pages, path, chunk_bytes=100)
    table = spark.read.parquet(path)
    table.where(~((F.col("record") == 0) & (F.col("chunk") == 2))).write.parquet(hurt)
    assert {r.page_id: r.intact for r in warc.read_records(spark, hurt).collect()} == {1: False, 2: True}
    joined = b"".join(bytes(r.bytes) for r in table.orderBy("record", "chunk").collect())
    assert joined.count(b"WARC/1.1\r\n") == 2 and joined.endswith(b"m\r\n\r\n")


def test_reader_takes_any_cuts():
    head, http = warc.head(3, "http://a", None, 5, "D", "1970-01-01T00:00:00Z")
    record = head + http + b"hello" + b"\r\n\r\n"
    for size in (1, 2, 3, 50, len(record)):
        reader = warc.Reader()
        for at in range(0, len(record), size):
            reader.feed(record[at : at + size])
        assert reader.row(True)[3:6] == (3, None, 5)
