"""Links and components against all pairs in numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import embeddings, queries


def slow(rows, threshold=0.95):
    good = []
    for _, v in rows:
        fine = v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, float) if fine else None)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = good[i], good[j]
            if i != j and a is not None and b is not None and len(a) == len(b):
                near[i, j] = a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold
    label = np.array([r[0] if r[0] is not None else 10**9 for r in rows])
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(n)])
        if (new == label).all():
            break
        label = new
    found = []
    for i, (vec_id, _) in enumerate(rows):
        c = None if label[i] == 10**9 else int(label[i])
        found.append((vec_id, int(near[i].sum()), c, vec_id == c))
    return sorted(found, key=str)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op9_embeddings(spark, SF).collect()), key=str) == slow(rows)


def test_many_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12))
    points = centres[rng.integers(0, 30, 400)] + rng.normal(size=(400, 12)) * 0.18
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embeddings.near_duplicates(frame, 0.95, block_rows=16)
    assert sorted(map(tuple, found.collect()), key=str) == slow(rows)


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    vectors = [None, [], [0.0, 0.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [1.0], [3.0], [1e30, 1e30], [1e-30, 1e-30], [1.0, 0.3], [-1.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(6, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("LINKS", F.lit(1))
    assert sorted(map(tuple, embeddings.near_duplicates(frame, 0.95).collect()), key=str) == sorted(
        [(i, n, c, True if i is None and c is None else k) for i, n, c, k in slow(rows)], key=str
    )


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(frame, 0.95).count() == 0
