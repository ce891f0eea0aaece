import base64
import gzip
import hashlib
import os

import duckdb
import pytest

from flowglass.llm import warc

SF = "/root/testdata/sf0.001"


def test_query_against_sql(spark):
    from flowglass.plans import catalog

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet' union all select page_id + 100000, url, html from '{SF}/pages.parquet' where page_id % 3 = 0 union all select 7777777, 'u', null")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"select {', '.join(cols)} from ({catalog.ORACLES['op1_warc']})").fetchall()
    src = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"pages-{os.getpid()}")
    os.makedirs(src, exist_ok=True)
    con.execute(f"copy pages to '{src}/pages.parquet' (format parquet)")
    got = [tuple(r[c] for c in cols) for r in warc.op1_warc(spark, src).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[3] == "revisit" for r in got)


def brute(rows, least):
    first = {}
    for p, _, h in rows:
        k = (h or "").encode()
        first[k] = min((x for x in (first.get(k), p) if x is not None), default=None)
    for p, u, h in rows:
        k = (h or "").encode()
        again = len(k) >= least and p != first[k]
        yield p, len(k), "sha1:" + base64.b32encode(hashlib.sha1(k).digest()).decode(), "revisit" if again else "response", first[k] if again else None


@pytest.mark.parametrize("least", [0, 10])
def test_edges_and_other_readers(spark, tmp_path, least):
    rows = [(5, "http://a/\r\nX: y", "same payload here"), (3, None, "same payload here"), (9, "c", None), (8, "d", ""), (None, "e", "x"), (1, "f", "\r\n\r\nWARC/1.1\r\n" * 999), (2, "g", "ü" * 100_000),
            (4, "g", "tie"), (4, "g", "tie"), (7, "g", "tie")]
    path = str(tmp_path / "out")
    warc.archive(spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string"), path, least)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_page"]
    got = [tuple(r[c] for c in cols) for r in warc.read(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, least), key=repr)
    # The same bytes for any gzip reader; plain archives and members without skip lengths read alike.
    data = b"".join(gzip.decompress(open(f"{path}/{f}", "rb").read()) for f in sorted(os.listdir(path)) if f.endswith(".gz"))
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(data)
    (other / "b.warc.gz").write_bytes(gzip.compress(data[: data.index(b"WARC/1.1", 10)]) if data.count(b"WARC-Type") > 1 else b"")
    again = [tuple(r[c] for c in cols) for r in warc.read(spark, str(other / "a.warc")).collect()]
    assert sorted(again, key=repr) == sorted(got, key=repr)
    assert warc.read(spark, str(other / "b.warc.gz")).count() == 1
    texts = {r.page_id: bytes(r.payload) for r in warc.read(spark, path, "page_id", "record_type", "payload").filter("record_type = 'response'").collect()}
    assert texts[2] == ("ü" * 100_000).encode() and texts[1] == b"\r\n\r\nWARC/1.1\r\n" * 999
    assert {r.page_id for r in warc.read(spark, path, "page_id", "target_uri").filter("target_uri like 'g%'").collect()} == {2, 4, 7}


def test_payloads_are_skipped_and_checked(spark, tmp_path):
    path = str(tmp_path / "x")
    warc.archive(spark.createDataFrame([(1, "u", "abc " * 5000)], "page_id long, url string, html string"), path)
    (name,) = [f for f in os.listdir(path) if f.endswith(".gz")]
    raw = bytearray(open(f"{path}/{name}", "rb").read())
    raw[-9] ^= 0xFF  # damages the end of the payload only
    open(f"{path}/{name}", "wb").write(raw)
    assert warc.read(spark, path, "page_id", "payload_bytes").collect()[0].payload_bytes == 20000
    with pytest.raises(Exception):
        warc.read(spark, path, "page_id", "payload").collect()


def test_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_digests_are_written_before_the_join_back(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 == 0 else f"page {i}") for i in range(30)], "page_id long, url string, html string")
    sides, join = [], type(pages).join
    monkeypatch.setattr(type(pages), "join", lambda self, other, *a, **k: sides.append(other) or join(self, other, *a, **k))
    warc.archive(pages, f"file://{tmp_path}/out")
    assert len(sides) == 1 and "Aggregate" not in sides[0]._jdf.queryExecution().optimizedPlan().toString()
    assert warc.read(spark, f"file://{tmp_path}/out", "record_type").filter("record_type = 'revisit'").count() == 9
