"""Components, exact deviations and whitened values against numpy's SVD of the centred rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from weekover.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>"


def integers(vectors):
    return [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]


def slow(vectors):
    """(n, deviations, centred, axes, eigenvalues, trace) by definition."""
    x = integers(vectors)
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    _, sizes, axes = np.linalg.svd(centred, full_matrices=True)
    values = np.zeros(centred.shape[1])
    values[: len(sizes)] = sizes**2 / n
    return n, deviations, centred, axes.T, values, values.sum()


def whitened(frame, **more):
    return whitening.whiten(frame, whitening.fitted(frame, **more), keep=["vec_id"]).collect()


def check(rows, ids, vectors):
    n, deviations, centred, axes, values, trace = slow(vectors)
    found = {r.vec_id: r for r in rows}
    assert sorted(found) == sorted(ids)
    got = np.array([[np.nan if x is None else x for x in found[i].whitened] for i in ids], float)
    for k in range(min(8, len(values))):
        if values[k] < trace * 1e-20:
            assert np.isnan(got[:, k]).all()
            continue
        want = centred @ axes[:, k] / math.sqrt(values[k])
        sign = np.sign(want @ got[:, k])
        # Rounding turns an axis by about its share of the largest one.
        assert np.allclose(got[:, k], sign * want, rtol=0, atol=1e-10 + 1e-14 * math.sqrt(values[0] / values[k]))
        assert all(abs(found[i].explained[k] * trace / values[k] - 1) < 1e-9 for i in ids)
    assert [int(found[i].deviation) for i in ids] == deviations
    assert {r.n for r in rows} == {n}
    assert all(r.identity_error < 1e-7 for r in rows)


def test_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = queries.op11_whitening(spark, SF).collect()
    n, deviations, centred, axes, values, trace = slow([r.embedding for r in table])
    place = {r.vec_id: i for i, r in enumerate(table)}
    assert sorted((r.vec_id, r.component) for r in rows) == sorted((i, k) for i in place for k in range(1, 9))
    for k in range(8):
        own = [r for r in rows if r.component == k + 1]
        want = centred @ axes[:, k] / math.sqrt(values[k])
        got = np.zeros(len(table))
        got[[place[r.vec_id] for r in own]] = [r.whitened for r in own]
        assert np.allclose(got, np.sign(want @ got) * want, rtol=0, atol=1e-7)
        assert all(abs(r.explained * trace / values[k] - 1) < 1e-4 for r in own)
    assert all(r.deviation == deviations[place[r.vec_id]] and r.n == n for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("spread", [1.0, 1e-3])
def test_uneven_axes(spark, spread):
    """Variances far apart beside a large common offset: products of uncentred rows would lose them."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    vectors = (rng.normal(size=(300, 10)) * spread ** np.arange(10)[::-1] * 5_000) @ turn + 20_000
    frame = spark.createDataFrame(list(enumerate(vectors.tolist())), SCHEMA).repartition(5)
    check(whitened(frame), list(range(300)), vectors.tolist())


def test_axes_without_variance(spark):
    rng = np.random.default_rng(4)
    base = np.round(rng.normal(size=(90, 3)) * 50)
    # Five columns of which two repeat others and one is constant.
    vectors = np.column_stack([base, base[:, 0], np.full(90, 7.0)]).tolist()
    frame = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(4)
    check(whitened(frame), list(range(90)), vectors)


def test_one_row_and_equal_rows(spark):
    frame = spark.createDataFrame([(i, [1.5, 2.0]) for i in (1, 1, 2)], SCHEMA)
    for rows, n in ((whitened(frame), 3), (whitened(frame.limit(1)), 1)):
        assert len(rows) == n
        for row in rows:
            assert row.whitened == [None, None] and row.explained == [0.0, 0.0]
            assert (row.n, int(row.deviation), row.identity_error) == (n, 0, 0.0)


def test_odd_vectors(spark):
    inf, nan = math.inf, math.nan
    odd = [None, [], [None, 1.0], [nan, 1.0], [inf, 1.0], [-inf, 1.0]]
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (None, [-3.0, 2.5]), (12, [0.0, 0.1])]
    longer = [(20, [1.0, 2.0, 3.0]), (21, [1.0, 2.0, 5.0])]
    rows = good + longer + [(i, v) for i, v in enumerate(odd)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("N", F.lit("n")).withColumn("vector", F.lit("v"))
    found = whitening.whiten(frame, whitening.fitted(frame))
    assert found.columns == ["vec_id", "embedding", "vector", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    assert sorted((r.vec_id, r.n) for r in found if r.vec_id) == [(10, 5), (11, 5), (11, 5), (12, 5), (20, 2), (21, 2)]
    assert len([r for r in found if r.vec_id is None]) == 1 and len(found) == 7
    _, deviations, _, _, _, _ = slow([v for _, v in longer])
    assert [int(r.deviation) for r in sorted(found, key=lambda r: r.vec_id or 0)[-2:]] == deviations


def test_large_entries(spark):
    vectors = [[1e12, 0.0], [-1e12, 1.0], [3e11, 5.0], [0.0, 1e-9]]
    frame = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    _, deviations, _, _, _, _ = slow(vectors)
    assert [int(r.deviation) for r in sorted(whitened(frame))] == deviations


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitened(frame) == []


def test_shift_and_solve():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(50, 6))
    factor = whitening.factor_of(rows.T @ rows, 50, shifted=True)
    assert np.allclose(whitening.turned(rows, [factor]) @ factor, rows)
    # Singular products need the shift, and get it unasked.
    rows[:, 5] = rows[:, 0]
    assert np.isfinite(whitening.factor_of(rows.T @ rows, 50, shifted=False)).all()
