import hashlib

import pytest

from lorekeep.llm.warc import ArchiveError, arc_record, arc_version_block, convert, read_arc, read_warc, round_trip, warc_date, warcinfo, write_archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_version(version):
    http = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\npay\nload \xff"
    data = arc_version_block("a.arc", version) + arc_record(version, {"url": "http://x/a", "date": "20200229010203", "type": "text/html"}, http) * 2
    records = list(read_arc(data))
    assert len(records) == 2 and records[0][1] == http and records[0][0]["url"] == "http://x/a"
    (headers, block), = read_warc(convert(*records[0], None, None))
    assert headers["warc-type"] == "response" and headers["warc-date"] == "2020-02-29T01:02:03Z" and block == http
    assert headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"pay\nload \xff").hexdigest()
    (headers, block), = read_warc(convert(*records[0], "3", "http://y"))
    assert headers["warc-type"] == "revisit" and headers["warc-refers-to-page-id"] == "3" and block.endswith(b"\r\n\r\n") and b"pay" not in block


def test_broken_archives():
    good = arc_version_block("a", 1) + arc_record(1, {"url": "http://x", "date": "2020", "type": "t"}, b"abc")
    for bad in (b"http://x 1 2 t 3\nabc\n", good[:-3], arc_version_block("a", 1) + b"http://x t 3\nabc\n", good + b"no end"):
        with pytest.raises(ArchiveError):
            list(read_arc(bad))
    record = warcinfo("x")
    with pytest.raises(ArchiveError):
        list(read_warc(record.replace(b"lorekeep", b"lorekeeq")))
    with pytest.raises(ArchiveError):
        list(read_warc(record[:-4]))
    assert warc_date("1999") == "1999-01-01T00:00:00Z"


LONG, SHORT = "é" * 60, "x" * 99
ROWS = [(1, "http://a b/1", LONG), (2, None, LONG), (3, "u3", SHORT), (4, "u4", SHORT), (5, "u5", None), (6, "u6", ""), (9, "u9", "y" * 200_000), (8, "u8", "y" * 200_000), (10, "u10", "WARC/1.0\r\n\r\n" * 20)]


def brute(rows):
    low, out = {}, {}
    for p, _, h in rows:
        b = (h or "").encode()
        low[b] = min(low.get(b, p), p)
    for p, _, h in rows:
        b = (h or "").encode()
        first = low[b] if len(b) >= 100 else p
        out[p] = (len(b), hashlib.sha256(b).hexdigest(), "response" if first == p else "revisit", None if first == p else first)
    return out


def test_round_trip(spark, sf):
    for rows in (ROWS, [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]):
        df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, refers_to int").repartition(3)
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(df).collect()}
        assert got == brute(rows)


def test_empty_and_segments(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert round_trip(df).count() == 0
    many = spark.createDataFrame([(i, "u", f"{i}" * 100_000) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    rows = write_archives(many).collect()
    assert len(rows) > 1 and sum(1 for r in rows for h, _ in read_warc(bytes(r.archive_bytes)) if h["warc-type"] == "response") == 60
