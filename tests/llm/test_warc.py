"""Operator 6: SQL parity, exact round trip, and archives that are broken on purpose."""

import gzip
import hashlib
import io
import zlib

import pytest

from conftest import SF01
from fedsearch.llm import queries, warc
from oracle_compare import compare, duck

PAGES = [(1, "http://a/ü\r\nx", "é" * 60), (2, None, "é" * 60), (3, "http://b", None), (4, "u", ""), (5, "u", "short"),
         (6, "u", "short"), (7, "u", "x" * 300_000), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
         (None, "u", "é" * 60), (0, "u", "x" * 300_000)]


def test_query_equals_sql(spark):
    r = compare(spark, duck(SF01), "op6", queries.op6_warc_round_trip, queries.ORACLE["op6_warc_round_trip"], SF01)
    assert r["ok"], r


def test_edges(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, refers_to string")
    got = sorted(map(tuple, warc.round_trip(spark, pages).collect()), key=str)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        to = first[html or ""] if len(body) >= 100 and first[html or ""] != i else None
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)
    empty = warc.round_trip(spark, pages.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_payloads_come_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:8], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", file_bytes=200)
    assert manifest.count() > 1 and manifest.agg({"n_records": "sum"}).first()[0] == 8
    rows = warc.read_archives(manifest, payloads=True).where("record_type = 'response'").collect()
    bodies = {r.record_id: bytes(r.payload) for r in rows}
    for i, _, html in PAGES[:8]:
        if i not in (2, 6):
            assert bodies[f"<urn:page:{i}>"] == (html or "").encode()
    assert b"short" == bodies["<urn:page:6>"]
    assert next(r.target_uri for r in rows if r.record_id == "<urn:page:1>") == "http://a/ü%0D%0Ax"


def member(body=b"hello", **wrong):
    raw = warc.record(1, "u", body, hashlib.sha256(body).hexdigest(), None)
    return gzip.compress(wrong["change"](raw) if wrong else raw)


def test_reader_frames_members():
    data = member(b"one") + member(b"") + member(b"x" * 100_000)
    for chunk in (1, 7, 1 << 16):
        got = [warc.parse(raw)[2] for _, raw in warc.members(io.BytesIO(data), chunk)]
        assert got == [b"one", b"", b"x" * 100_000]


@pytest.mark.parametrize("change", [lambda r: r.replace(b"hello", b"hullo"), lambda r: r[:-1], lambda r: r + b"x",
                                    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: b""])
def test_broken_records_raise(tmp_path, change):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(member() + member(change=change))
    with pytest.raises(ValueError, match="a.warc.gz"):
        list(warc.records(path.as_uri()))


def test_cut_member_raises():
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(member()[:-5])))
