"""ARC parsing, WARC equivalents, and the round trip through files."""

import gzip
import hashlib
import io

import duckdb
import pytest

from tesserae.llm import warc
from tesserae.llm.registry import ORACLE, op1_warc


def test_query_equals_sql(spark, d="/root/testdata/sf0.01"):
    con = duckdb.connect()
    con.sql(f"create view pages as from '{d}/pages.parquet'")
    assert sorted(tuple(r) for r in op1_warc(spark, d).collect()) == sorted(con.sql(ORACLE["op1_warc"]).fetchall())


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lengths_delimit_bodies(version):
    bodies = [b"HTTP/1.0 200 OK\r\n\r\nhttp://x 0.0.0.0 20200101000000 text/html 3\nabc", b"", b"\xff\n\n\n", b"HTTP/1.1 404 Not\n\nx"]
    urls = ["http://a/b c", "dns:a", "ftp://z", "q"]
    found = list(warc.parse_arc(warc.make_arc(iter(zip(urls, bodies, strict=True)), version)))
    assert [(r.url, r.body) for r in found[1:]] == list(zip(urls, bodies, strict=True))
    made = [warc.to_warc(r) for r in found]
    assert [r.kind for r in made] == ["warcinfo", "response", "resource", "resource", "response"]
    assert made[4].payload == b"x" and made[2].content_type == "text/dns"
    assert len({r.record_id for r in made}) == 5
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.make_arc(iter([("http://a", b"abc")]), version)[:-3]))


def test_dates():
    assert warc.iso_date("20240506070809") == "2024-05-06T07:08:09Z" and warc.iso_date("202405") == "2024-05-01T00:00:00Z"


def brute(rows):
    out = []
    for k, _, h, *_ in rows:
        raw = (h or "").encode()
        same = [x for x, _, g, *_ in rows if (g or "") == (h or "") and x is not None]
        revisit = len(raw) >= 1000 and k is not None and k < max(same)
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("version", "most"), [(1, 50_000), (2, 0)])
def test_odd_rows_and_files(spark, tmp_path, monkeypatch, version, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    big = "é\r\n\r\nWARC/1.1\r\n" * 400
    rows = [(1, "http://a b\nc", big), (5, None, big), (3, "http://x", big), (5, "http://y", big), (7, "http://x", "short"), (9, "http://x", "short"), (11, "", None), (None, "http://n", big), (12, "u", ""), (13, "dns:a", "d"), (14, "filedesc://b c", big), (14, "filedesc://b c", big), (15, "HTTP/1.0\x00", "e"), (-4, "http://m", "q" * 2_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/w"
    got = warc.convert(df, path, version)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    files = [f for f in (tmp_path / "w").glob("part-*") if f.stat().st_size > 60]
    told = []
    for f in files:
        heads = [h for h, _ in warc.parse_warc(gzip.GzipFile(fileobj=io.BytesIO(f.read_bytes())))]
        kinds = [h["warc-type"] for h in heads]
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        told += heads
    by = {h["warc-record-id"]: h for h in told}
    assert len(by) == len(told) == len(rows) + len(files)
    again = [h for h in told if h["warc-type"] == "revisit"]
    assert again and all(by[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"] for h in again)
    assert all(by[h["warc-refers-to"]]["warc-type"] == "response" for h in again)
    assert {h["warc-target-uri"] for h in told if "warc-target-uri" in h} >= {"dns:a", "%66iledesc://b%20c", "http://a%20b%20c"}
    assert warc.convert(df.limit(0), f"file://{tmp_path}/e", version).count() == 0


def test_bytes_survive_the_text_sink(spark, tmp_path):
    raw = bytes(range(256)) * 50
    arcs = spark.createDataFrame([(warc.make_arc(iter([("http://b", warc.http_answer(raw, 4))])),)], "arc binary")
    none = spark.createDataFrame([], "record_id string, refers long, refers_id string")
    warc.write_warc(warc.records(arcs), none, f"file://{tmp_path}/b")
    assert [tuple(r) for r in warc.read_warc(spark, f"file://{tmp_path}/b").collect()] == [(4, len(raw), hashlib.sha1(raw).hexdigest(), "response", None)]
