"""Archives: exact round trips, revisits, pushed filters, skipped payloads."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from adtally.llm.registered import QUERIES, table
from adtally.llm.warc import WarcReader, archive_records, read_warc, write_warc

ROWS = [
    (1, "http://a/1", "same", 0), (2, "http://a/2", "same", 0), (3, "http://b/\r\n3", None, 0), (4, None, "", 0),
    (5, "http://b/é", "other é\r\n\r\nWARC/1.1\r\n", 0), (None, "http://n", "same", 0), (7, "x", "long " * 200_000, 0), (2, "http://a/2", "same", 0),
]
SCHEMA = "page_id long, url string, html string, payload int"


def want(rows):
    largest = {}
    for page, _, html, _ in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = largest[html or ""]
        out.append((page, len(raw), digest, "response" if page == first else "revisit", None if page == first else first))
    return sorted(out, key=repr)


COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_of_odd_pages(spark, tmp_path, compression):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    write_warc(archive_records(pages), f"file://{tmp_path}/w", compression, roll_bytes=200)
    got = read_warc(spark, f"file://{tmp_path}/w", COLUMNS, verify=True).collect()
    assert sorted(map(tuple, got), key=repr) == want(ROWS)
    whole = {(r.page_id, r.record_type): r for r in read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert bytes(whole[5, "response"].payload) == ROWS[4][2].encode() and whole[1, "revisit"].payload is None
    assert bytes(whole[7, "response"].payload) == ROWS[6][2].encode()
    assert whole[5, "response"].target_uri == "http://b/é"
    if compression == "gzip":
        plain = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
        assert plain.count(b"WARC-Type: ") == len(ROWS)


def test_small_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    kinds = {r.record_type for r in archive_records(pages, least_bytes=5).where("payload_bytes < 5").collect()}
    assert kinds == {"response"}


def test_filters_and_payloads_left_alone(spark, tmp_path):
    write_warc(archive_records(spark.createDataFrame(ROWS, SCHEMA)), f"{tmp_path}/w")
    frame = read_warc(spark, f"{tmp_path}/w", "page_id long, record_type string, target_uri string")
    chosen = frame.where((F.col("record_type") == "response") & F.col("target_uri").startswith("http://b"))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0], "both tests are answered by the reader"
    assert {r.page_id for r in chosen.collect()} == {5} and frame.where("page_id in (1, 7)").count() == 2


def test_unwanted_members_are_passed_by_their_length(spark, tmp_path):
    write_warc(archive_records(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)), f"{tmp_path}/w")

    class Counting(io.BytesIO):
        read_bytes = 0

        def size(self):
            return len(self.getvalue())

        def read_at(self, count, at):
            Counting.read_bytes += count
            return self.getvalue()[at : at + count]

    schema = read_warc(spark, f"{tmp_path}/w", "page_id long").schema
    reader = WarcReader({"path": str(tmp_path)}, schema)
    found = [r for p in (tmp_path / "w").glob("*.gz") for r in reader.records(Counting(p.read_bytes()))]
    assert len(found) == len(ROWS) and all(r["payload"] is None for r in found)
    plain = gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert [r["record_type"] for r in reader.records(Counting(plain * 2))] == ["warcinfo"] * 2, "members without skip lengths"


def test_empty_archive(spark, tmp_path):
    write_warc(archive_records(spark.createDataFrame([], SCHEMA)), f"{tmp_path}/w")
    assert read_warc(spark, f"{tmp_path}/w").count() == 0


def test_pages_of_a_table(spark, small):
    rows = [(r.page_id, r.url, r.html, 0) for r in table(spark, small, "pages").collect()]
    assert sorted(map(tuple, QUERIES["op5_warc"](spark, small).collect()), key=repr) == want(rows)
