import base64
import gzip
import hashlib
import io

import pytest

from pitchframe.llm import warc
from tests.llm.helpers import SF

SCHEMA = "page_id long, url string, html string, label int"


def brute(rows, least=0):
    first, out = {}, []
    key = lambda i: (i is not None, i or 0)
    rows = sorted(rows, key=lambda r: key(r[0]))
    for page, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = data in first and len(data) >= least
        out.append((page, len(data), digest, "revisit" if revisit else "response", first[data] if revisit else None))
        first.setdefault(data, page)
    return sorted(map(str, out))


def result(pages, **options):
    rows = warc.round_trip(pages, **options).collect()
    assert all(r["fault"] is None and r["digest_holds"] for r in rows)
    return sorted(str(tuple(r)[:5]) for r in rows)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = brute([(r["page_id"], r["html"]) for r in pages.collect()])
    assert result(pages) == want
    assert result(pages, segment_chars=700, chunk_chars=90, archive_bytes=50_000) == want


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "x\r\n\r\nWARC/1.1\r\n"), (4, "x\r\n\r\nWARC/1.1\r\n"), (4, "x\r\n\r\nWARC/1.1\r\n"), (4, "other"), (5, "é🙂" * 4_000), (6, "0\r\n\r\n"), (9, "é🙂" * 4_000), (None, "no number")]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/\r\n{i}", h, 1) for i, h in rows], SCHEMA)
    assert result(pages) == brute(rows)
    assert result(pages, segment_chars=5, chunk_chars=3) == brute(rows)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "ab"), (2, "ab"), (3, "a longer one"), (4, "a longer one")]
    pages = spark.createDataFrame([(i, "u", h, 1) for i, h in rows], SCHEMA)
    assert result(pages, min_revisit_bytes=5) == brute(rows, 5)


def test_records_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x", "hello", 1), (2, "http://y", "hello", 1)], SCHEMA)
    warc.write_archives(pages, str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse_archive(io.BytesIO(gzip.decompress(f.read_bytes())))]
    assert sorted(r["warc-type"] for r in records) == ["response", "revisit"]
    response = next(r for r in records if r["warc-type"] == "response")
    assert response["block"].endswith(b"\r\n\r\n5\r\nhello\r\n0\r\n\r\n")


def test_segments_that_make_no_whole(spark):
    schema = warc._RECORD
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    row = lambda i, origin, n, total, b=block: (i, 1, None, "response" if origin is None else "continuation", None, None, origin, n, total, bytearray(b))
    rows = [row("a", None, 1, None), row("a2", "a", 2, 44), row("b2", "b", 2, 9), row("c", None, 1, None), row("d", None, 1, None), row("d3", "d", 3, 44), row("e", None, 1, None), row("e2", "e", 2, 45)]
    got = {r["key"]: r["fault"] for r in warc.reassemble(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": None, "b": "no first segment", "c": "no last segment", "d": "segments missing or repeated", "e": "total length not met"}


def test_chunks():
    assert warc.decode_chunked(b"3;x=y\r\nabc\r\n1\r\nd\r\n0\r\n\r\n") == b"abcd"
    with pytest.raises(ValueError):
        warc.decode_chunked(b"5\r\nabc\r\n0\r\n\r\n")
