"""Codes, errors and codebooks against the plain search over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import codes, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def finite(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def slow(rows, entries=16, rounds=6):
    """The contract's rows, in Python integers."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if finite(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    digest, result = [], []
    for n in sorted({len(v) for _, v, _ in kept}):
        widths = [n // 8 + (k < n % 8) for k in range(8)]
        starts = [sum(widths[:k]) for k in range(8)]
        cut = lambda v, k: v[starts[k] : starts[k] + widths[k]]  # noqa: E731, B023
        own = [r for r in kept if len(r[1]) == n]
        first = [v for _, v, _ in order if len(v) == n][:entries]
        books = [[cut(v, k) for v in first] for k in range(8)]
        near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))
        for _ in range(rounds):
            for k in range(8):
                found = [near(cut(v, k), books[k])[1] for _, v, _ in own]
                for j in range(len(books[k])):
                    mine = [cut(v, k) for (_, v, _), f in zip(own, found) if f == j]
                    if mine:
                        books[k][j] = [sum(c) // len(mine) for c in zip(*mine)]
        for i, v, label in own:
            best = [near(cut(v, k), books[k]) for k in range(8)]
            result.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), label))
        digest += [str(x) for book in books for entry in book for x in entry]
    sha = hashlib.sha256(",".join(digest).encode()).hexdigest()
    totals = {}
    for _, _, error, label in result:
        totals[label] = totals.get(label, 0) + error
    return sorted(((i, code, error, totals[label], sha) for i, code, error, label in result), key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.where("vec_id % 4 = 0").collect()]
    assert found(queries.coded(table.where("vec_id % 4 = 0"))) == slow(rows)


def test_ties_and_repeated_rows(spark):
    random.seed(9)
    # Few different values: equal entries, equal distances and entries that nothing is near.
    rows = [(i // 2, [random.choice([0.0, 1.0, -1.0]) for _ in range(16)], random.choice([None, 1, 2])) for i in range(120)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(queries.coded(frame)) == slow(rows)


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    vectors = [None, [None] * 8, [nan] * 8, [inf] * 8, [], [0.0], [-0.00001] * 8, [1.5] * 9, [2.5] * 9, [1e6] * 8, [1e9] * 8]
    rows = [(i, v, None if i % 2 else i % 3) for i, v in enumerate(vectors)] + [(None, [3.0] * 8, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(queries.coded(frame)) == slow(rows)
    wide = frame.withColumn("CODE", F.lit(1)).withColumn("vector", F.lit(2))
    assert codes.encoded(wide, codes.fitted(wide)).columns == ["vec_id", "embedding", "label", "vector", "code", "error"]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert queries.coded(frame).count() == 0


@pytest.mark.parametrize("scale", [3, 40, 1 << 40])
def test_search(scale):
    """The expanding search returns what trying every entry returns."""
    random.seed(scale)
    draw = lambda m, w: np.array([[random.randint(-scale, scale) for _ in range(w)] for _ in range(m)], object)
    for width in (1, 2, 5):
        parts, entries = draw(200, width), draw(random.randint(1, 20), width)
        if scale < 1 << 20:
            parts, entries = parts.astype(np.int64), entries.astype(np.int64)
        index, distance = codes.nearest(parts, entries)
        for part, i, d in zip(parts, index, distance):
            plain = [((part - e) ** 2).sum() for e in entries]
            assert d == min(plain) and i == plain.index(min(plain))


def test_codes_stand_for_entries(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    books = codes.fitted(table, rounds=2)
    for row in codes.encoded(table, books).limit(20).collect():
        entry = codes.decoded(books, 64, row.code)
        assert row.error == sum((math.floor(4096 * x) - e) ** 2 for x, e in zip(row.embedding, entry))
