"""Held-out accuracy, the risk estimator, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import queries, toxicity


def test_query_on_the_held_out_fold(spark, documents):
    rows = queries.op6_toxicity(spark, SF).collect()
    ids = [r.doc_id for r in documents.collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert sum(p == t for p, t in known) >= 0.9 * len(known)
    assert not any(p and not t for p, t in known)


def test_features_of_the_text_alone():
    assert toxicity.features(None) == toxicity.features("") == set()
    assert toxicity.features("Idiots, a") == {"idiots", "a", "idio*", "idiot*"}
    assert toxicity.features("a b a a") == {"a", "a#2", "a#3", "b"}
    model = toxicity.Model({"idiot*": 3.0, "idiot*#2": 1.0, "a": -1.0}, -2.0)
    for text in ("Idiots, a", "IDIOTIC idiots", "idiot", "", None):
        z = -2.0 + sum(model.weights.get(f, 0) for f in toxicity.features(text))
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_positive_and_unlabelled_rows_suffice():
    rng = np.random.default_rng(1)
    positive = [[0, int(rng.integers(2, 30))] for _ in range(200)]
    unlabelled = [[0] * (i % 5 == 0) + [int(rng.integers(2, 30)), 1] for i in range(1000)]
    w, b, risks = toxicity.train(positive, unlabelled, 30, 0.2)
    assert w[0] + b > 0 > w[1] + b and risks[-1] < risks[0]
    assert min(risks) >= 0


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "moron"), (4, "word " * 60_000), (4, "moron")] + [
        (10 + i, f"some {'moron' if i % 3 == 0 else 'fine thing'} here {i}") for i in range(400)
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("SCORE", F.lit("x"))
    labels = [(10 + i, int(i % 3 == 0)) for i in range(400)] + [(None, 1), (11, None), (12345, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(frame, labels)
    rows = toxicity.scored(frame, model).collect()
    assert len(rows) == len(docs)
    assert all((r.score >= 0.5) == ("moron" in (r.text or "")) for r in rows)
    none = toxicity.fitted(frame, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.scored(frame, none).collect()} == {0.0}
    empty = frame.limit(0)
    assert toxicity.scored(empty, toxicity.fitted(empty, labels)).count() == 0


def test_few_labels_suffice(spark):
    docs = [(10 + i, f"some {'moron' if i % 3 == 0 else 'fine thing'} here {i}") for i in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(10 + i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    rows = toxicity.scored(frame, toxicity.fitted(frame, labels)).collect()
    assert all((r.score >= 0.5) == ("moron" in r.text) for r in rows)


def test_words_of_few_known_documents_are_learned(spark):
    # Each insult is in 4 of 40 known documents, and in their copies among the unlabelled.
    docs = [(i, f"text {i} of insult{chr(97 + i % 10)} kind" if i < 50 else f"text {i} of plain kind") for i in range(800)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(0, 400)], "doc_id long, toxic int")
    words = {f for f, w in toxicity.fitted(frame, labels).weights.items() if w > 0}
    known = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    often = {f"insult{chr(97 + k)}" for k in range(10) if sum(i % 10 == k for i in known) >= toxicity.LEAST_DOCUMENTS}
    assert len(often) > 5 and often <= words


def test_most_toxic_documents_are_found(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(r.predicted, toxic[r.doc_id], r.held_out) for r in queries.op6_toxicity(spark, SF).collect() if r.doc_id in toxic]
    held = [(p, t) for p, t, out in known if out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert not any(p and not t for p, t, _ in known)
    assert sum(t and not p for p, t, _ in known) <= 0.1 * sum(t for _, t, _ in known)
