import base64
import gzip
import hashlib
import os

import pytest

from tests.llm.conftest import SMALL
from vetrina.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, first int")


ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://x/\r\nWARC-Type: fake", "é" * 70_000),
        (6, "http://é/", "WARC/1.1\r\n\r\n\r\n"), (7, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "v", "alone"), (8, "w", "twice"), (8, "w", "twice")]


def expected(rows, least=0):
    out = []
    for page_id, _, text in rows:
        data = (text or "").encode()
        same = [i for i, _, t in rows if (t or "") == (text or "") and i is not None]
        first = min(same) if same else None
        revisit = len(data) >= least and page_id != first
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, tmp, least):
    warc.write(warc.records(pages(spark, ROWS).repartition(3), least), tmp + "/w", file_bytes="2000")
    got = warc.read(spark, tmp + "/w", partition_bytes="1000")
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == expected(ROWS, least)
    for r in got.collect():
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest and len(r.payload) == r.payload_bytes
        else:
            assert r.payload is None
    uris = {r.page_id: r.target_uri for r in got.collect()}
    assert uris[1] == "http://a/1" and uris[3] is None and uris[5] == "http://x/%0D%0AWARC-Type: fake"


def test_members_are_plain_gzip(spark, tmp):
    warc.write(warc.records(pages(spark, ROWS).coalesce(1)), tmp + "/w")
    name = next(n for n in os.listdir(tmp + "/w") if n.endswith(".gz"))
    raw = gzip.open(f"{tmp}/w/{name}").read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: ") and raw.count(b"\r\nWARC-Record-ID: ") == len(ROWS)
    os.makedirs(tmp + "/plain")  # the same records without gzip, and as members that don't name their length
    with open(tmp + "/plain/a.warc", "wb") as f:
        f.write(raw)
    with open(tmp + "/plain/b.warc.gz", "wb") as f:
        for r in raw.split(b"\r\n\r\nWARC/1.1\r\nWARC-Type")[:1]:
            f.write(gzip.compress(r + b"\r\n\r\n"))
        f.write(gzip.compress(warc.record(77, "u", "response", None, hashlib.sha1(b"z").hexdigest(), 1, b"z", "d")))
    got = warc.read(spark, tmp + "/plain", payload="false")
    assert got.count() == len(ROWS) + 2
    assert got.where("page_id = 77").first().payload_bytes == 1


def test_filters_are_pushed_and_payloads_skipped(spark, tmp, monkeypatch):
    reader = warc.WarcReader({"path": tmp + "/w"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3), EqualTo(("page_id",), 2)]))
    assert [f.attribute for f in left] == [("payload_bytes",)] and len(reader.filters) == 2
    warc.write(warc.records(pages(spark, ROWS)), tmp + "/w")
    part = [p for x in reader.partitions() for p in x.paths]
    monkeypatch.setattr(warc._Block, "bytes", lambda *a: pytest.fail("a payload was decoded"))
    store, _ = warc._store(tmp)
    rows = [r for p in part for r in warc.read_file(store, p, lambda x: x["record_type"] == "revisit", True, True)]
    assert {r["page_id"] for r in rows} == {2, 7, 4, None}


def test_spark_pushes_filters(spark, tmp):
    warc.write(warc.records(pages(spark, ROWS)), tmp + "/w")
    got = warc.read(spark, tmp + "/w").where("record_type = 'revisit' AND page_id > 1 AND target_uri IS NOT NULL AND payload_bytes > 0")
    assert sorted(r.page_id for r in got.collect()) == [2, 7]


def test_damage_is_an_error(spark, tmp):
    os.makedirs(tmp + "/w")
    good = warc.record(1, "u", "response", None, hashlib.sha1(b"right").hexdigest(), 5, b"wrong", "d")
    with open(tmp + "/w/x.warc", "wb") as f:
        f.write(good)
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read(spark, tmp + "/w").collect()
    assert warc.read(spark, tmp + "/w", verify="false").first().payload == b"wrong"
    with open(tmp + "/w/x.warc", "wb") as f:
        f.write(good[:-6])
    with pytest.raises(Exception, match="shorter than its Content-Length"):
        warc.read(spark, tmp + "/w", verify="false").collect()


def test_uncommitted_files_are_not_read(spark, tmp):
    warc.write(warc.records(pages(spark, ROWS)), tmp + "/w")
    with open(tmp + "/w/part-lost.warc.gz", "wb") as f:
        f.write(b"half a member of a lost task")
    assert warc.read(spark, tmp + "/w").count() == len(ROWS)


def test_empty_table(spark, tmp):
    warc.write(warc.records(pages(spark, [])), tmp + "/w")
    assert warc.read(spark, tmp + "/w").count() == 0


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in warc.query(spark, SMALL).collect()), key=str) == expected(rows)
