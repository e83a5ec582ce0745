import duckdb
import pytest
from binomia.llm import warc

PAGES = "page_id bigint, url string, html string"


@pytest.fixture
def pages(spark):
    body = "<p>" + "same " * 40 + "</p>"
    rows = [(3, "http://a/", body), (1, "http://b/", body), (2, None, body), (9, "http://c/\nd", "short"), (8, "u", "short"), (4, "u", None), (5, "u", ""), (6, "ü", "é" * 60), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]
    return spark.createDataFrame(rows, PAGES)


def oracle(pages):
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    return sorted(c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE_SQL})").fetchall())


def test_roundtrip(spark, pages):
    path = warc.archive(pages)
    assert sorted(map(tuple, warc.page_records(spark, path).collect())) == oracle(pages)
    payloads = {r.record_id: bytes(r.payload) for r in warc.read_archive(spark, path).where("record_type = 'response'").collect()}
    assert payloads["<urn:x-page:7>"].startswith(b"WARC/1.1") and payloads["<urn:x-page:6>"] == ("é" * 60).encode()


def test_nulls_and_repeats(spark):
    body = "x" * 200
    pages = spark.createDataFrame([(None, "a", body), (1, "b", body), (1, "b", body), (None, None, None)], PAGES)
    got = warc.page_records(spark, warc.archive(pages)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 200, "response", None), (1, 200, "response", None), (None, 200, "revisit", 1), (None, 0, "response", None)], key=str)


def test_empty(spark):
    path = warc.archive(spark.createDataFrame([], PAGES))
    assert warc.page_records(spark, path).collect() == []


def test_predicates_are_pushed(spark, pages):
    path = warc.archive(pages)
    q = warc.read_archive(spark, path, ["record_type", "target_uri"]).where("record_type = 'revisit' and target_uri like 'http:%'")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert [r.target_uri for r in q.collect()] == ["http://a/"]
    q = warc.read_archive(spark, path, ["record_id", "content_length", "record_type"]).where("content_length > 300 or record_type is null")
    assert q.count() == warc.read_archive(spark, path).where("content_length > 300").count() > 0


def test_plain_file_and_foreign_records(spark, tmp_path):
    raw = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(raw)
    got = warc.read_archive(spark, f"file://{tmp_path}").collect()
    assert [(r.record_type, bytes(r.payload)) for r in got] == [("warcinfo", b"abc"), ("resource", b"hi")]
    (tmp_path / "x.warc").write_bytes(raw[:-10])
    with pytest.raises(Exception, match="ends before"):
        warc.read_archive(spark, f"file://{tmp_path}").collect()
