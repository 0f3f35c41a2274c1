"""Embedding whitening by shifted CholeskyQR.

Entries are made integers, so counts, sums and deviations are exact. The centred rows are
orthogonalised in passes over the data: each pass turns the rows by the triangular factors
found so far (a triangular solve per factor, in tasks), adds up their products, and takes
the Cholesky factor of the small matrix that results. The first factor is taken of a matrix
with a shift on its diagonal, which no condition of the data can make fail; the passes after
it remove the shift's effect. The product of the factors is the R of the data's QR, so its
singular values and vectors give the components without ever squaring what is small.

Directions in which the data do not vary are found by the last pass, where they hold nothing
while all others have length one. Their whitened values are NULL, what they explain is zero.

NULL vectors and vectors with NULL or non-finite entries are dropped; empty vectors have no
components and are dropped too. Vectors of different lengths are whitened apart, each length
with its own rows as fit list. Repeated rows count as often as they occur, ties between
eigenvalues are taken in any order, and ids play no part (a NULL id is kept). An empty table
gives an empty result. Other columns pass through; one with the name of a result is replaced.
Lengths are bounded by ``vectors.FIT_NUMBERS``, entries by ``vectors.LARGEST``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.llm import vectors as V
from weekover.llm.common import fresh, map_arrow, with_columns

# Passes that orthogonalise: two do unless directions are empty or nearly so.
PASSES = 6
# What a direction's squared length is in the end: about one, or nothing.
FULL, EMPTY = 0.99, 1e-9


@dataclass(frozen=True)
class Integers:
    """How entries become integers: floor(scale * entry) + shift."""

    scale: int = 1024
    shift: int = 100_000


@dataclass(frozen=True)
class Centre:
    """Count of the rows of one length and the sums of their integers."""

    n: int
    sums: np.ndarray  # Python integers

    def gaps(self, vectors: np.ndarray, integers: Integers) -> np.ndarray:
        """n * x - sums, exactly."""
        bound = (1 << 62) // max(self.n, 1)
        x = V.floored(vectors, integers.scale, bound, integers.shift)
        sums = self.sums
        if x.dtype != object and abs(sums).max(initial=0) < 1 << 62:
            sums = sums.astype(np.int64)
        return self.n * x - sums

    def centred(self, vectors: np.ndarray, integers: Integers) -> np.ndarray:
        return self.gaps(vectors, integers).astype(np.float64) / self.n


@dataclass(frozen=True)
class Whitening:
    """What is fitted to the rows of one length; ``axes`` has a column per component."""

    centre: Centre
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def whitened(self, vectors: np.ndarray, integers: Integers) -> np.ndarray:
        """A column per component that varies."""
        used = self.values > 0
        return (self.centre.centred(vectors, integers) @ self.axes[:, used]) / np.sqrt(self.values[used])


def centres(frame: DataFrame, embedding: str, integers: Integers) -> dict[int, Centre]:
    """Exact counts and sums of the rows of each length."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for _, vectors in V.matrices(batch.column(0)):
                x = V.floored(vectors, integers.scale, 1 << 40, integers.shift)
                n, total = vectors.shape[1], x.sum(axis=0)
                known = totals.setdefault(n, [0, np.zeros(n, object)])
                known[0] += len(x)
                known[1] = known[1] + V.wide(total)
        for n, (count, sums) in totals.items():
            if n:
                columns = [pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([count] * n), V.decimals(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["length", "pos", "n", "total"])

    parts = map_arrow(frame.select(V.doubles(frame, embedding)), partial, "length int, pos int, n long, total decimal(38,0)")
    lengths = parts.groupBy("length").agg(F.sum("n")).limit(V.LENGTHS + 1).collect()
    V.check_lengths([r["length"] for r in lengths], lambda n: n * n)
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for row in parts.groupBy("length", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        found.setdefault(row["length"], {})[row["pos"]] = (row["n"], int(row["total"]))
    return {n: Centre(rows[0][0], np.array([rows[i][1] for i in range(n)], object)) for n, rows in found.items()}


def turned(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The rows times the inverse of each upper triangular factor in turn."""
    columns = rows.T
    for factor in factors:
        solved = np.empty_like(columns)
        for j in range(len(factor)):
            solved[j] = (columns[j] - factor[:j, j] @ solved[:j]) / factor[j, j]
        columns = solved
    return columns.T


def factor_of(products: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; with a shift that rounding errors cannot exceed if asked for or needed."""
    d, size = len(products), float(np.trace(products))
    if size == 0:
        return np.eye(d)
    if not shifted:
        try:
            return np.linalg.cholesky(products).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * size
    return np.linalg.cholesky(products + shift * np.eye(d)).T


def fitted(
    frame: DataFrame, embedding: str = "embedding", components: int = 8, integers: Integers = Integers()
) -> dict[int, Whitening]:
    """The whitening of each length of vectors."""
    column = V.doubles(frame, embedding)
    known = centres(frame, embedding, integers)
    factors: dict[int, list[np.ndarray]] = {n: [] for n in known}
    last: dict[int, np.ndarray] = {}
    while len(last) < len(known):
        open_factors = {n: f for n, f in factors.items() if n not in last}

        def rows_of(vectors: np.ndarray, use=open_factors) -> np.ndarray | None:
            n = vectors.shape[1]
            return turned(known[n].centred(vectors, integers), use[n]) if n in use else None

        for n, products in V.summed_products(frame, column, rows_of).items():
            done = factors[n]
            lengths = np.linalg.eigvalsh(products)
            if len(done) >= 2 and (((lengths > FULL) | (lengths < EMPTY)).all() or len(done) == PASSES):
                last[n] = products
            else:
                done.append(factor_of(products, known[n].n, shifted=not done))
    models = {n: _model(known[n], factors[n], products, components) for n, products in last.items()}

    def rows_whitened(vectors: np.ndarray) -> np.ndarray | None:
        n = vectors.shape[1]
        return models[n].whitened(vectors, integers) if n in models and models[n].values[0] > 0 else None

    measured = V.summed_products(frame, column, rows_whitened)
    errors = {n: float(np.abs(p / known[n].n - np.eye(len(p))).max()) for n, p in measured.items()}
    return {n: Whitening(m.centre, m.axes, m.values, m.explained, errors.get(n, 0.0)) for n, m in models.items()}


def _model(centre: Centre, factors: list[np.ndarray], products: np.ndarray, components: int) -> Whitening:
    lengths, axes = np.linalg.eigh(products)
    root = np.sqrt(np.where(lengths < FULL / 2, 0, lengths))[:, None] * axes.T
    for factor in reversed(factors):
        root = root @ factor
    _, sizes, found = np.linalg.svd(root)
    sizes = np.where(sizes <= sizes[0] * len(sizes) * 4 * np.finfo(float).eps, 0, sizes)
    values = sizes * sizes / centre.n
    found = found[:components].T
    # Either sign is right: the largest entry of a component is positive.
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    total = values.sum()
    explained = values[:components] / total if total > 0 else np.zeros(len(values[:components]))
    return Whitening(centre, found * signs, values[:components], explained, 0.0)


def whiten(
    frame: DataFrame,
    models: dict[int, Whitening],
    embedding: str = "embedding",
    keep: list[str] | None = None,
    integers: Integers = Integers(),
) -> DataFrame:
    """Adds n, deviation, whitened, explained and identity_error to every row that is not dropped.

    ``deviation`` is the sum of (n * x - sum)^2 over the dimensions, exact; ``whitened`` and
    ``explained`` have an entry per component.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        size = batch.num_rows
        n, deviation, whitened = [None] * size, [None] * size, [None] * size
        explained, error = [None] * size, [None] * size
        for at, vectors in V.matrices(batch.column(0)):
            model = models.get(vectors.shape[1])
            if model is None:
                continue
            gaps = model.centre.gaps(vectors, integers)
            if gaps.dtype != object and float(np.abs(gaps).max(initial=0)) ** 2 * max(gaps.shape[1], 1) > 2.0**62:
                gaps = V.wide(gaps)
            squares = (gaps * gaps).sum(axis=1)
            values = np.full((len(at), len(model.values)), np.nan)
            if model.values[0] > 0:
                values[:, model.values > 0] = model.whitened(vectors, integers)
            shares = model.explained.tolist()
            for i, square, row in zip(at.tolist(), squares.tolist(), values.tolist()):
                n[i], deviation[i], explained[i], error[i] = model.centre.n, square, shares, model.identity_error
                whitened[i] = [None if x != x else x for x in row]
        lists = pa.list_(pa.float64())
        return {
            "n": pa.array(n, pa.int64()),
            "deviation": pa.array([None if d is None else V.Decimal(d) for d in deviation], pa.decimal128(38, 0)),
            "whitened": pa.array(whitened, lists),
            "explained": pa.array(explained, lists),
            "identity_error": pa.array(error, pa.float64()),
        }

    numbers = T.ArrayType(T.DoubleType())
    added = {
        "n": T.LongType(),
        "deviation": T.DecimalType(38, 0),
        "whitened": numbers,
        "explained": numbers,
        "identity_error": T.DoubleType(),
    }
    vector = fresh(frame, "vector")
    rows = frame.withColumn(vector, V.doubles(frame, embedding))
    return with_columns(rows, make, [vector], added, frame.columns if keep is None else keep).where("n IS NOT NULL")
