"""Targets against plain water-filling, and what the mix takes against the targets."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, epochs=3.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    clamped = set()
    while True:
        rest = sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        open_ = [s for s in order if s not in clamped]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        more = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not more:
            return {s: share.get(s, epochs * sizes[s]) for s in order}
        clamped |= more


def assert_mixed(rows, docs, slack):
    sizes, source_of = defaultdict(int), {}
    for doc_id, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
        source_of[doc_id] = source
    expected = slow_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        source = source_of[r.doc_id]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(expected[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for source, target in expected.items():
        assert abs(taken[source] - target) <= slack * target, (source, taken[source], target)


def test_query(spark, documents):
    docs = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    rows = queries.op4_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    assert_mixed(rows, docs, 0.02)
    assert sorted(rows) == sorted(queries.op4_mixing(spark, SF).collect())


def test_targets_of_many_sources(spark):
    random.seed(13)
    # Sizes over many orders of magnitude, each clamped after another; equal ones too.
    sizes = {f"s{i:05d}": int(1.008 ** (i // 2)) for i in range(3_000)}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    weighted = sources.join(mixing.rotating_weights(sources.select("source")), "source")
    found = {r.source: r.target for r in mixing.targets(weighted, 3.0).collect()}
    assert found == pytest.approx(slow_targets(sizes))


def test_sources_without_weight_or_words(spark):
    rows = [("a", 100, 1.0), ("b", 100, 0.0), ("c", 0, 2.0), ("d", 10, 1.0)]
    sources = spark.createDataFrame(rows, "source string, source_size long, weight double")
    found = {r.source: r.target for r in mixing.targets(sources, 3.0).collect()}
    assert found == pytest.approx({"a": 180.0, "b": 0.0, "c": 0.0, "d": 30.0})
    assert mixing.targets(sources.limit(0), 3.0).count() == 0


def test_odd_rows(spark):
    docs = [(i, "w " * (i % 7), "big") for i in range(200)] + [(i, "one two", None) for i in range(200, 205)]
    docs += [(300, None, "none"), (301, "a", "tiny"), (302, "a " * 30_000, "é"), (303, "b", "é")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("DRAW", F.lit(1))
    rows, _ = mixing.mix(frame)
    rows = rows.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken").collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.taken for r in rows}[301] <= 3
    repeated = mixing.repeated(frame)
    assert repeated.columns == frame.columns
    counts = {r.doc_id: r.n for r in repeated.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(counts.get(r.doc_id, 0) * r.size == r.taken for r in rows)


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty)[0].count() == 0 and mixing.repeated(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 2, empty.schema)
    assert [r.copies * r.size for r in mixing.mix(nulls)[0].collect()] == [0, 0]


def test_one_long_document_leaves_room_for_those_behind_it(spark):
    short = [100] * 10, [100] * 70 + [7, 3] * 20
    for long in (20_000, 15_000):
        sizes = [*short[0], long, *short[1]]
        # Far apart and close together: neighbours share bins of the histograms.
        for step in (mixing.DRAWS // len(sizes), 1):
            rows = [("=s", size, i * step) for i, size in enumerate(sizes)]
            rows = spark.createDataFrame(rows, "source_key string, size long, draw long")
            total = sum(sizes)
            sources = spark.createDataFrame([("=s", total, 8_000.0)], "source_key string, source_size long, target double")
            taken = rows.join(mixing.plan(rows, sources), "source_key").withColumn("copies", mixing.copies())
            copies = [(r["size"], r.copies) for r in taken.collect()]
            assert {c for _, c in copies} == {0, 1}
            assert abs(sum(s * c for s, c in copies) - 8_000) < min(s for s, c in copies if not c)


def test_no_document_more_or_less_brings_the_sum_nearer(spark, documents):
    rows, _ = mixing.mix(documents)
    side = "min(size) FILTER (WHERE size > 0 AND copies {} floor(target / source_size))"
    for r in rows.groupBy("source", "target").agg(
        F.sum(F.expr("size * copies")).alias("taken"),
        F.expr(side.format("=")).alias("left"),
        F.expr(side.format(">")).alias("more"),
    ).collect():
        least = r.left if r.taken < r.target else r.more
        assert least is None or abs(r.taken - r.target) < least, r
