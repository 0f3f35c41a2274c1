"""SimHash against brute force over all pairs of fingerprints."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import queries, simhash


def slow_fingerprint(text, size=3):
    words = [w for w in (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def slow_components(ids, fingerprints, distance=3):
    f = np.array(fingerprints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= distance
    label = np.array(ids)
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def assert_as_brute_force(rows, texts):
    ids = sorted(texts)
    prints = [slow_fingerprint(texts[i]) for i in ids]
    expected = dict(zip(ids, zip((f"{p:016x}" for p in prints), slow_components(ids, prints))))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == expected


def test_query_equals_brute_force(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = queries.op2_simhash(spark, SF).collect()
    assert len(rows) == len(texts)
    assert_as_brute_force(rows, texts)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "One", 5: "one", 6: "two words", 7: "x " * 50_000, 8: "x x x", 9: "Éa b c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("FP", F.lit(1))
    assert_as_brute_force(simhash.near_duplicates(docs, 3, 3).collect(), texts)


def test_empty_and_unnamed(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty, 3, 3).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    rows = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, 3, 3).collect()}
    assert rows == {(None, 4), (4, 4), (None, None)}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", 1), (1, "a b c d", 2), (1, "a b c d", 2), (2, "z y x w v", 3), (2, None, 4), (9, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash long")
    kept = simhash.deduplicated(docs, 3, 3)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, "a b c d"), (2, ""), (2, "z y x w v")]


@pytest.mark.parametrize("node_rows", [1, 50])
def test_large_nodes_are_divided(spark, node_rows):
    rng = np.random.default_rng(5)
    near = rng.integers(0, 2**64, 6, np.uint64)[rng.integers(0, 6, 300)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.concatenate([near, rng.integers(0, 2**64, 100, np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    from weekover.llm.components import connected

    members = {r.node: r.component for r in connected(simhash.forest_links(fps, 3, node_rows)).collect()}
    signed = [int(v) for v in values.view(np.int64)]
    expected = slow_components(signed, values)
    assert [members.get(v, v) for v in signed] == expected


def test_chain_of_links(spark):
    from weekover.llm.components import connected

    links = spark.range(0, 200).selectExpr("id + 1 AS a", "id AS b")
    assert {r.component for r in connected(links).collect()} == {0}
