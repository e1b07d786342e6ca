"""WARC archives: exact round trips, broken and foreign archives, framing."""

import base64
import gzip
import hashlib
import random

import pytest

from agrolith.llm import warc


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(table):
    """(page_id, bytes, digest, type, refers_to) by the contract."""
    first = {}
    for i, _, h in table:
        first.setdefault(h or "", []).append(i)
    out, seen = [], set()
    for i, _, h in sorted(table, key=lambda r: (r[0] is None, r[0])):
        p = (h or "").encode()
        again = (h or "") in seen
        seen.add(h or "")
        out.append((i, len(p), sha1(p), "revisit" if again else "response", min(x for x in first[h or ""] if x is not None) if again else None))
    return sorted(out, key=str)


MARKED = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\nfalse\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n\nWARC/1.\nWARC/1."
PAGES = [
    (5, "http://a.org/x y\r\nWARC-Type: revisit\r\n\r\n", "<html>one</html>"),
    (3, "http://a.org/3", "<html>one</html>"),
    (9, None, "<html>one</html>"),
    (4, "http://b.org", None),
    (6, "http://b.org", ""),
    (7, "http://b.org", "é東\x00\r\n0\r\n\r\n"),
    (8, "http://c.org", MARKED),
    (10, "http://c.org", MARKED + "x"),
    (11, "http://c.org", "ab" * 150_000 + MARKED),
    (12, "http://c.org", "\r\n\r" * 5000),
    (None, "http://c.org", "no id"),
    (12, "http://c.org", "repeated"),
    (12, "http://c.org", "repeated"),
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip_of_odd_pages(spark, tmp_path, compression):
    pages = spark.createDataFrame([(*r, 1, "k", 2) for r in PAGES], "page_id long, url string, html string, again long, same string, block int")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)  # plain archives are read in pieces
        warc.write(pages.repartition(2), str(tmp_path / "w"), segment_bytes=1000, chunk_bytes=70, compression=compression)
        got = warc.read(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {r.problem for r in got} == {None} and len(got) == len(PAGES)
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(PAGES)
    rows = []
    for r in got:
        at = by_id[r.refers_to] if r.record_type == "revisit" else r
        assert at.record_type == "response" and at.payload_digest == r.payload_digest
        i = lambda x: None if x.page_id is None else int(x.page_id)
        rows.append((i(r), len(at.payload), sha1(bytes(at.payload)), r.record_type, i(at) if r is not at else None))
    assert sorted(rows, key=str) == expected(PAGES)
    assert {bytes(r.payload) for r in got if r.payload is not None} == {(h or "").encode() for _, _, h in PAGES}
    assert max(r.segments for r in got) > 300
    assert {r.url for r in got if r.page_id == "5"} == {"http://a.org/x%20y%0D%0AWARC-Type:%20revisit%0D%0A%0D%0A"}


def test_small_payloads_may_all_be_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), least_bytes=3)
    got = {r.page_id: r.record_type for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_empty_tables_and_archives(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def record(kind, block, *, length=None, **more):
    names = {"id": "WARC-Record-ID", "origin": "WARC-Segment-Origin-ID", "number": "WARC-Segment-Number", "total": "WARC-Segment-Total-Length", "digest": "WARC-Payload-Digest", "content": "content-type"}
    head = "".join(f"{names[k]}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.0\r\nWARC-Type:{kind}\r\n{head}content-length:  {len(block) if length is None else length} \r\n\r\n".encode() + block + b"\r\n\r\n"


HTTP = "Application/HTTP;msgtype=response"
PLAIN = b"HTTP/1.1 200 OK\r\n\r\n"
CHUNKED = b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip, chunked\r\n\r\n"


def test_foreign_and_broken_archives(spark, tmp_path):
    whole = CHUNKED + warc.chunked(b"hello world" * 9, 7)
    cut = [whole[:30], whole[30:77], whole[77:]]
    parts = [record("response", cut[0], id="<a>", number=1, content=HTTP, digest="sha1:" + sha1(b"hello world" * 9))] + [record("continuation", c, id=f"<a{n}>", origin="<a>", number=n, **({"total": len(whole)} if n == 3 else {})) for n, c in ((2, cut[1]), (3, cut[2]))]
    one = [parts[2], record("warcinfo", b"software: x", id="<info>"), record("response", PLAIN + b"plain", id="<b>", content=HTTP), record("resource", b"as it is", id="<c>")]
    two = [
        parts[1], parts[1], parts[0],
        record("response", CHUNKED + b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n", id="<d>", content=HTTP),
        record("response", CHUNKED + b"<html>not framed", id="<e>", content=HTTP),
        record("response", b"no head", id="<f>", content=HTTP),
        record("response", PLAIN + b"x", id="<g>", content=HTTP, digest="sha1:" + sha1(b"y")),
        record("response", PLAIN + b"1", id="<h>", content=HTTP, number=1), record("continuation", b"3", id="<h3>", origin="<h>", number=3, total=len(PLAIN) + 2),
        record("response", PLAIN + b"1", id="<i>", content=HTTP, number=1), record("continuation", b"2", id="<i2>", origin="<i>", number=2, total=999),
        record("response", PLAIN + b"1", id="<j>", content=HTTP, number=1), record("continuation", b"2", id="<j2>", origin="<j>", number=2),
        record("continuation", b"2", id="<k2>", origin="<k>", number=2, total=9),
        record("revisit", b"", id="<r>", digest="sha1:" + sha1(b"plain")),
        record("response", PLAIN + b"cut off", id="<z>", content=HTTP, length=5000),
    ]
    (tmp_path / "one.warc").write_bytes(b"".join(one))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, two)))  # a gzip member for each record
    (tmp_path / "three.warc").write_bytes(b"no record at all")
    got = {r.record_id: (r.record_type, None if r.payload is None else bytes(r.payload), r.segments, r.problem) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {
        "<a>": ("response", b"hello world" * 9, 3, None),
        "<info>": ("warcinfo", b"software: x", 1, None),
        "<b>": ("response", b"plain", 1, None),
        "<c>": ("resource", b"as it is", 1, None),
        "<d>": ("response", b"abc", 1, None),
        "<e>": ("response", b"<html>not framed", 1, "not chunked"),
        "<f>": ("response", b"no head", 1, "no http head"),
        "<g>": ("response", b"x", 1, "wrong digest"),
        "<h>": ("response", None, 2, "segment missing"),
        "<i>": ("response", None, 2, "wrong total length"),
        "<j>": ("response", None, 2, "segment missing"),
        "<k>": ("continuation", None, 1, "segment missing"),
        "<r>": ("revisit", None, 1, None),
        "<z>": ("response", None, 1, "truncated"),
    }


def test_chunked_framing():
    rng = random.Random(3)
    for _ in range(300):
        payload = bytes(rng.choice(b"ab\r\n0;1") for _ in range(rng.randrange(60)))
        framed = warc.chunked(payload, rng.randrange(1, 20))
        assert warc.unchunked(framed) == payload
        assert warc.unchunked(framed[:-1]) is None
    for broken in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"-1\r\n\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        assert warc.unchunked(broken) is None
