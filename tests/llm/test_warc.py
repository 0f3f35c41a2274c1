"""Archives written and read back, pushdown, ranges, and archives by other writers."""

import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import queries, warc


def expected(pages):
    groups = defaultdict(list)
    for page_id, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups[data].append(page_id)
    result = []
    for page_id, html in pages:
        data = (html or "").encode()
        holder = max(groups.get(data, [page_id]))
        revisit = page_id != holder
        result.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", holder if revisit else None))
    return sorted(result)


def test_query(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, queries.op1_warc(spark, SF).collect())) == expected(pages)
    sql = queries.ORACLES["op1_warc"]
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(con.execute(sql).fetchall()) == expected(pages)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    big = "x" * 1000
    pages = [(1, "http://a/\r\nWARC-Type: evil", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "é" * 499)]
    pages += [(6, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", "\r\n\r\nWARC/1.1\r\n" + "y" * 200_000), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("PAYLOAD", F.lit(1))
    path = str(tmp_path_factory.mktemp("odd") / "warc")
    warc.archive(frame.repartition(2), path)
    return path, [(p, h) for p, _, h in pages]


def test_odd_pages(spark, odd):
    path, pages = odd
    assert sorted(map(tuple, warc.restored(spark, path).collect())) == expected(pages)
    found = spark.read.format("warc").load(path)
    assert found.where("record_type = 'warcinfo'").count() >= 1
    row = found.where("record_id = '<urn:x-page:1>'").first()
    assert row.target_uri == "http://a/%0D%0AWARC-Type: evil" and row.record_type == "revisit" and row.payload is None
    assert found.where("target_uri IS NULL AND record_type = 'response'").count() == 1


def test_ranges_meet_every_record_once(spark, odd):
    path, pages = odd
    for split in (1, 50, 700):
        found = spark.read.format("warc").option("splitBytes", split).load(path).where("record_type <> 'warcinfo'")
        assert sorted(r.record_id for r in found.select("record_id").collect()) == sorted(f"<urn:x-page:{p}>" for p, _ in pages)


def test_conditions_are_pushed(spark, odd):
    path, _ = odd
    plan = spark.read.format("warc").load(path).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    reader = warc.WarcReader(path, None, 1 << 20)
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert [f.attribute for f in kept] == [("payload_bytes",)]


def test_unwanted_payloads_are_not_inflated(odd, monkeypatch):
    path, _ = odd
    reader = warc.WarcReader(path, None, 1 << 20)
    list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    inflated = []
    rest = warc._Members.rest
    monkeypatch.setattr(warc._Members, "rest", lambda self, *a: inflated.append(a[-1]) or rest(self, *a))
    rows = [r for p in reader.partitions() for r in reader._records(p, False, True)]
    assert len(rows) == 2 and not any(inflated)


def test_archives_by_others(spark, tmp_path):
    one = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "<urn:a>", "Content-Type": "text/plain"}, b"hello")
    two = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<urn:b>", "Content-Type": warc.HTTP}, b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody" + b"z" * 9000)
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in rows) == sorted([("<urn:a>", b"hello"), ("<urn:b>", b"body" + b"z" * 9000)] * 2)
    sizes = spark.read.format("warc").schema("record_id string, payload_bytes long").load(str(tmp_path)).distinct().collect()
    assert sorted(map(tuple, sizes)) == [("<urn:a>", 5), ("<urn:b>", 9004)]


def test_empty_table_and_lost_attempts(spark, tmp_path):
    path = str(tmp_path / "warc")
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(empty, path)
    (tmp_path / "warc" / "part-lost-00000.warc.gz").write_bytes(b"cut off")
    assert warc.restored(spark, path).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (None, None, "x" * 2000), (None, None, "x" * 2000)], empty.schema)
    warc.archive(nulls, path)
    assert sorted(r.payload_bytes for r in warc.restored(spark, path).collect()) == [0, 2000, 2000]
