"""Numeric vectors in Arrow batches: matrices of equal length, exact integers, summed matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.llm.common import map_arrow

# Vectors of different lengths are fitted apart. What is fitted lies on the driver and goes
# to every task, so lengths and the numbers of a fit are bounded; beyond that is an error.
LENGTHS, FIT_NUMBERS = 64, 1 << 24
# Integers above this do not fit the exact sums.
LARGEST = 10**18


def doubles(frame: DataFrame, embedding: str) -> F.Column:
    return F.col(f"`{embedding}`").cast("array<double>")


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, their vectors) for each length; NULL vectors and those with NULL or non-finite entries left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(pc.list_flatten(column), np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        found = flat[starts[at][:, None] + np.arange(n)]
        good = np.isfinite(found).all(axis=1)
        if good.any():
            yield at[good], found[good]


def floored(vectors: np.ndarray, scale: int, limit: int, shift: int = 0) -> np.ndarray:
    """floor(scale * x) + shift: as 64-bit integers if none exceeds ``limit``, as Python integers otherwise."""
    scaled = np.floor(vectors * scale)
    largest = np.abs(scaled).max(initial=0)
    if largest + abs(shift) <= limit:
        return scaled.astype(np.int64) + shift
    if not largest < LARGEST:
        raise ValueError(f"a vector has an entry above {LARGEST // scale}")
    return wide(scaled) + shift


def wide(numbers: np.ndarray) -> np.ndarray:
    """The same integers without a bound on their size."""
    return np.array([int(x) for x in numbers.ravel()], object).reshape(numbers.shape)


def decimals(numbers: Iterable[int]) -> pa.Array:
    return pa.array([Decimal(int(x)) for x in numbers], pa.decimal128(38, 0))


def check_lengths(lengths: Iterable[int], numbers: Callable[[int], int]) -> None:
    lengths = list(lengths)
    if len(lengths) > LENGTHS or sum(map(numbers, lengths)) > FIT_NUMBERS:
        raise ValueError(f"vectors of {len(lengths)} lengths, up to {max(lengths)}, are too many for one fit")


def summed_products(
    frame: DataFrame, column: F.Column, rows_of: Callable[[np.ndarray], np.ndarray | None]
) -> dict[int, np.ndarray]:
    """For each length of vectors the sum of the outer products of the rows ``rows_of`` makes of them.

    Tasks add up their own rows; their matrices are added row by row in other tasks, so the
    driver gets one matrix for each length, however many tasks there are.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, vectors in matrices(batch.column(0)):
                rows = rows_of(vectors)
                if rows is not None:
                    n = vectors.shape[1]
                    totals[n] = totals.get(n, 0) + rows.T @ rows
        yield from _rows((n, i, row) for n, total in totals.items() for i, row in enumerate(total))

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for n, i, values in zip(*(batch.column(k).to_pylist() for k in range(3))):
                totals[n, i] = totals.get((n, i), 0) + np.array(values)
        yield from _rows((n, i, row) for (n, i), row in totals.items())

    schema = "length int, i int, row array<double>"
    parts = map_arrow(frame.select(column.alias("vector")), partial, schema)
    found: dict[int, dict[int, list[float]]] = {}
    for row in map_arrow(parts.repartition("length", "i"), added, schema).collect():
        found.setdefault(row["length"], {})[row["i"]] = row["row"]
    return {n: np.array([rows[i] for i in sorted(rows)]) for n, rows in found.items()}


def _rows(rows: Iterable[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for n, i, row in rows:
        columns = [pa.array([n], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["length", "i", "row"])
