"""Verdicts against plain matching of every rule with every url."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import queries, urls

RULES = "host string, path string, verdict string"


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    return lower, re.match(r"[^?#]*", rest[len(raw) :])[0]


def slow_verdict(url, rules):
    host, path = slow_parts(url)
    best = None
    for h, p, verdict in rules if url is not None else ():
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(h + p) + 1, len(h) + 1, h + p, verdict))
    return (host, path, *(best[2:] if best else (None, "allow")))


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = {r.page_id: tuple(r)[1:] for r in queries.op8_urls(spark, SF).collect()}
    assert rows == {r.page_id: slow_verdict(r.url, queries.URL_RULES) for r in pages}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert {r[0]: r[1:] for r in con.execute(queries.ORACLES["op8_urls"]).fetchall()} == rows


def test_nested_and_odd(spark):
    random.seed(4)
    hosts = ["a.b", "b", "c.a.b", "xa.b", "B", "b.", "", "é.b", "a,b", "b:80"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/yz?q=/x", "/x#f", "/é/1", "//", "/x\n/y"]
    found = [None, "", "b/x", "http:/b/x", "://", "a://b://c/x"] + [f"http://{random.choice(hosts)}{random.choice(paths)}" for _ in range(400)]
    rules = [("b", "", "allow"), ("b", "/x", "block"), ("b", "/x/y", "allow"), ("a.b", "/x", "allow"), ("a.b", "/", "block"), ("", "/x/", "block"), ("é.b", "/é", "block"), ("a,b", "/", "block"), ("c.a.b", "/x/yz", "block")]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string").withColumn("RULE", F.lit("x")).withColumn("key", F.lit(0))
    frame = spark.createDataFrame([*rules, rules[1], ("b", "/x/y", "block"), ("b", None, None)], RULES)
    rules[2] = ("b", "/x/y", "block")
    for buckets in (None, 2, 7, 60):
        rows = urls.judged(pages, frame, buckets=buckets)
        assert rows.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
        for r in rows.collect():
            assert tuple(r)[3:] == slow_verdict(r.url, rules), r


def test_drawn_rules(spark):
    """Hosts nested in hosts and paths in paths, marks of the key inside labels, a popular host, very long urls."""
    random.seed(15)
    label = lambda: random.choice(["a", "b", "ab", "a\x01b", "b\x00", "\x02a", "\U0010ffff", "é", ""])
    host = lambda n: ".".join(label() for _ in range(random.randint(1, n)))
    path = lambda n: "".join(random.choice(["/", "x", "é", "\U0010ffff"]) for _ in range(random.randint(0, n)))
    rules = list({(h, p): (h, p, random.choice(["allow", "block"])) for h, p in ((host(3), path(3)) for _ in range(80))}.values())
    found = [f"x://{host(4)}/{path(5)}" for _ in range(500)] + [f"x://b.a/{k}" for k in range(300)]
    found += ["x://a/" + "y" * 100_000, "x://" + "a." * 20_000 + "b/x"]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    frame = spark.createDataFrame(rules, RULES)
    for buckets in (3, 40):
        for r in urls.judged(pages, frame, buckets=buckets).collect():
            assert tuple(r)[2:] == slow_verdict(r.url, rules), r


def test_buckets_share_a_popular_host(spark):
    found = [(f"x://b.a/{k}", "b.a", f"/{k}") for k in range(4000)] + [("x://c/", "c", "/")]
    each = spark.createDataFrame(found, "url string, host string, path string")
    keyed = each.withColumn("key", F.concat(urls.reversed_host("host"), F.lit(urls.END), F.hex(F.xxhash64("url"))))
    bounds = urls.bounds_of(keyed, 10)
    assert len(bounds) == 9
    bucket = urls._bucket(bounds, lambda b: b <= F.col("key"))
    sizes = {r.bucket: r["count"] for r in keyed.select(bucket.alias("bucket"), "key").groupBy("bucket").count().collect()}
    assert max(sizes.values()) < 1200 and set(sizes) == set(range(10))
    for r in keyed.select(bucket.alias("bucket"), "key").collect():
        assert r.bucket == sum(b.encode() <= r.key.encode() for b in bounds)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], RULES)
    assert urls.judged(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://b/"), (1, "http://b/"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in urls.judged(one, rules).collect()] == ["allow"] * 3
