import gzip
import hashlib
import re

import pytest
from keyweave.llm.warc import page_records, read_warc, write_warc

BIG = "<p>" + "é" * 600


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/\r\n1", BIG), (2, "http://b", BIG), (9, None, BIG), (9, "http://b", BIG), (None, "u", BIG), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "v", BIG + "x"), (8, "v", "\r\n\r\nWARC/1.1\r\n\r\n" * 3)]
    return spark.createDataFrame([(*r, 1, "c") for r in rows], "page_id long, url string, html string, keeper int, digest string")


@pytest.fixture
def archive(pages, tmp_path):
    path = f"file://{tmp_path}/warc"
    write_warc(page_records(pages).repartition(3), path)
    return path


def test_pages_come_back(spark, pages, archive):
    back = read_warc(spark, archive).collect()
    assert len(back) == pages.count()
    by_id = {}
    for r in back:
        by_id.setdefault(r.record_id, []).append(r)
    for p in pages.collect():
        raw = (p.html or "").encode()
        for r in by_id[f"<urn:page:{'' if p.page_id is None else p.page_id}>"]:
            assert r.payload_digest == hashlib.sha1(raw).hexdigest() and r.payload_length == len(raw)
            revisit = p.html == BIG and p.page_id != 9
            assert (r.record_type, r.refers_to) == (("revisit", "<urn:page:9>") if revisit else ("response", None))
            assert (None if r.payload is None else bytes(r.payload)) == (None if revisit else raw)
    assert by_id["<urn:page:1>"][0].target_uri == "http://a/ 1"


def test_predicates_reach_the_source(spark, archive):
    df = read_warc(spark, archive)
    some = df.where("record_type = 'revisit'")
    assert some.count() == 3 and sorted(r.record_id for r in some.collect()) == ["<urn:page:1>", "<urn:page:2>", "<urn:page:>"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if re.match(r"[ :+*()\d-]*Filter ", x)], plan
    assert df.where("target_uri like 'http://%' and record_type in ('response', 'other')").count() == 1
    assert df.where("payload_length > 1000 and target_uri = 'v'").count() == 1
    assert read_warc(spark, archive, payload=False).where("payload is not null").count() == 0


def test_other_writers_archives(spark, tmp_path):
    def record(kind, body, extra=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\r\n\r\nworld"
    records = [record(b"warcinfo", b"software: x\r\n"), record(b"response", http, b"Content-Type: application/http; msgtype=response\r\n"), record(b"request", b"GET /" + b"x" * 200_000), record(b"resource", b"")]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(b"".join(records))
    (tmp_path / "plain/b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "plain/c.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    df = read_warc(spark, f"file://{tmp_path}/plain")
    assert {r.record_type: (r["count"]) for r in df.groupBy("record_type").count().collect()} == {"warcinfo": 3, "response": 3, "request": 3, "resource": 3}
    assert {bytes(r.payload) for r in df.where("record_type = 'response'").collect()} == {b"hello\r\n\r\nworld"}
    assert df.where("record_type = 'request' and length(payload) > 200000").count() == 3
    assert read_warc(spark, f"file://{tmp_path}/plain/b.warc.gz").count() == 4


def test_a_cut_archive_is_an_error(spark, tmp_path):
    whole = gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 5000\r\n\r\n" + bytes(range(256)) * 20)
    (tmp_path / "x.warc.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="ends within"):
        read_warc(spark, f"file://{tmp_path}/x.warc.gz").collect()


def test_no_pages(spark, pages, tmp_path):
    write_warc(page_records(pages.limit(0)), f"file://{tmp_path}/none")
    assert read_warc(spark, f"file://{tmp_path}/none").count() == 0
