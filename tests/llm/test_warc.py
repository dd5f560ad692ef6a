import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidelog.llm import warc
from tidelog.llm.common import fresh_path

PAGES = "page_id long, url string, html string"


def expected(rows, shortest=0):
    groups = {}
    for page_id, _, html in rows:
        b = (html or "").encode()
        if len(b) >= shortest and page_id is not None:
            groups[b] = max(groups.get(b, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        b = (html or "").encode()
        first = groups.get(b)
        revisit = first is not None and (page_id is None or page_id < first)
        out.append((page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [(1, "http://a", "<p>x"), (2, None, "<p>x"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000), (None, "u", "<p>x"), (6, "u", "z" * 200_000)]


@pytest.mark.parametrize("shortest", [0, 5])
def test_round_trip(spark, shortest):
    pages = spark.createDataFrame(ROWS, PAGES).withColumn("digest", F.lit("mine")).repartition(3)
    assert got(warc.warc_round_trip(pages, shortest_revisit=shortest)) == expected(ROWS, shortest)


def test_whole_table(spark, sf, pages):
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert got(warc.warc_round_trip(pages)) == expected(rows)


def test_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_come_back_from_segments(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(ROWS, PAGES), path, segment_bytes=1000, archive_records=7)
    records = warc.read_records(spark, path)
    assert records.where("type = 'continuation'").count() > 100
    payloads = {r.page_id: bytes(r.payload) for r in warc.reassemble(records).where("payload is not null and page_id is not null").collect()}
    assert payloads == {i: (h or "").encode() for i, _, h in ROWS if i not in (None, 1, 3)}


def test_lost_segment_is_noticed(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(ROWS, PAGES), path, segment_bytes=1000)
    for lost in ("segment = 2", "total is not null"):
        with pytest.raises(Exception, match="segments do not add up"):
            warc.reassemble(warc.read_records(spark, path).where(f"segment is null or not ({lost})")).collect()


def test_framing():
    for body in (b"", b"a", b"x" * 10_000):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc", b"3\r\nabcX\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_archives_are_plain_warc(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_archives(spark.createDataFrame(ROWS[:1], PAGES).coalesce(1), path)
    text = gzip.decompress(next((tmp_path / "a").glob("*.gz")).read_bytes())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"0\r\n\r\n\r\n\r\n")
