"""Embedding near-duplicates by an epsilon grid order join.

On unit vectors a cosine of at least ``threshold`` is a distance of at most epsilon. The
vectors are turned to their principal axes, which keeps distances, and sorted by the cells
of a grid of that width on the leading axes. The sorted sequence is cut into large blocks. Two
blocks whose bounding boxes are further apart than epsilon are skipped; each other pair is
a tile that one task joins, recursively: intervals that are provably too far apart are
dropped whole, the others halved, and pairs of short intervals compared, first on the
leading axes alone and then by the cosine in double precision. A block meets itself where it
lies, and travels once for each tile; the boxes meet on the cells of three axes.

Equal vectors are taken once with their count. A task returns link counts and a spanning
forest, never the pairs. The axes are fitted on a bounded sample; they only decide how much
is skipped, not what is found.

Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with
nothing, and so do vectors of different lengths. Rows that share an id are rows like any
other; a NULL id is kept and names no component. Vectors of any length are compared whole.
An empty table gives an empty result, and other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weekover.llm.common import batch_rows, lookup, map_arrow, written
from weekover.llm.components import connected
from weekover.llm.simhash import _union

# Vectors the axes are fitted on, and leading axes of the grid.
SAMPLE, GRID_AXES = 4096, 6
# Most vectors and numbers of a block, vectors of the shortest intervals, and axes compared
# at first. A task holds two blocks.
BLOCK, BLOCK_NUMBERS, SHORT, FIRST_AXES = 1 << 14, 1 << 20, 128, 16
# Axes whose cells blocks meet on.
MEETING_AXES = 3
# Slack of the comparisons that only skip: single precision is far finer than this.
SLACK = 1e-4


def _valid(name: str) -> str:
    return (
        f"{name} IS NOT NULL AND size({name}) > 0 AND exists({name}, x -> x <> 0) AND "
        f"forall({name}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < DOUBLE('Infinity'))"
    )


def _units(vectors: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components stay in range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by falling variance for each length of vector in a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("vector").collect()
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    return {n: np.linalg.svd(_units(np.array(found, float)), full_matrices=True)[2].T for n, found in by_length.items()}


def _turned(vectors: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    units = _units(vectors)
    return units @ axes[units.shape[1]] if units.shape[1] in axes else units


def _with_cells(vectors: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Adds ``cells``, the grid cells on the leading axes."""
    sent = vectors.sparkSession.sparkContext.broadcast(axes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [None] * batch.num_rows
            rows = [np.asarray(v, float) for v in batch.column("vector").to_pylist()]
            for n in {len(v) for v in rows}:
                at = [i for i, v in enumerate(rows) if len(v) == n]
                own = _turned(np.stack([rows[i] for i in at]), sent.value)[:, :GRID_AXES]
                for i, c in zip(at, np.floor(own / epsilon).astype(int).tolist()):
                    cells[i] = c
            columns = [*batch.columns, pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cells"])

    return map_arrow(vectors, run, "vector array<double>, n long, first long, cells array<int>")


BLOCKS = (
    "block long, length int, single boolean, nodes binary, vectors binary, counts binary, firsts array<long>, "
    "low array<double>, high array<double>"
)
PARTS = ("block", "single", "nodes", "vectors", "counts")


def _rows(length: int, size: int) -> int:
    """Vectors of a block of that length."""
    return max(1, min(size, BLOCK_NUMBERS // length))


def _numbers(data: bytes, single: bool, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if single else np.float64).reshape(rows, -1).astype(np.float64)


def _cut(axes_sent, size: int):
    """Sorted rows (vector, n, first) to blocks of consecutive ones of one length."""
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def block(rows: list[tuple], number: int) -> dict:
        vectors = np.array([r[0] for r in rows], float)
        turned = _turned(vectors, axes_sent.value)
        # Half as long where single precision holds the same numbers.
        with np.errstate(over="ignore"):
            short = vectors.astype(np.float32)
        single = bool((short == vectors).all())
        return {
            "block": number,
            "length": vectors.shape[1],
            "single": single,
            "nodes": (number * size + np.arange(len(rows), dtype=np.int64)).tobytes(),
            "vectors": (short if single else vectors).tobytes(),
            "counts": np.array([r[1] for r in rows], np.int64).tobytes(),
            "firsts": [r[2] for r in rows],
            "low": turned.min(axis=0).tolist(),
            "high": turned.max(axis=0).tolist(),
        }

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers do not meet: those of a task begin at its place among the partitions.
        number, held = TaskContext.get().partitionId() << 24, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= _rows(len(row[0]), size) or len(held[0][0]) != len(row[0])):
                    yield pa.RecordBatch.from_pylist([block(held, number)], schema=schema)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([block(held, number)], schema=schema)

    return run


class _Sequence:
    """A block's vectors in order, with the bounding boxes of a binary tree of intervals."""

    def __init__(self, row: dict, side: str, axes: dict[int, np.ndarray]):
        self.nodes = np.frombuffer(row[f"nodes_{side}"], np.int64)
        self.counts = np.frombuffer(row[f"counts_{side}"], np.int64)
        self.vectors = _numbers(row[f"vectors_{side}"], row[f"single_{side}"], len(self.nodes))
        self.units = _units(self.vectors)
        n = self.units.shape[1]
        self.turned = self.units @ axes[n] if n in axes else self.units
        self.leading = np.ascontiguousarray(self.turned[:, :FIRST_AXES], np.float32)
        self.squares = (self.leading * self.leading).sum(axis=1)
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        known = self.boxes.get((start, stop))
        if known is None:
            if stop - start > SHORT:
                middle = (start + stop) // 2
                one, two = self.box(start, middle), self.box(middle, stop)
                known = np.minimum(one[0], two[0]), np.maximum(one[1], two[1])
            else:
                part = self.turned[start:stop]
                known = part.min(axis=0), part.max(axis=0)
            self.boxes[(start, stop)] = known
        return known


def _join(a: _Sequence, b: _Sequence, same: bool, threshold: float, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Places of linked vectors in the two sequences, each pair once."""
    limit = 2 - 2 * threshold + SLACK
    stack = [(0, len(a.nodes), 0, len(b.nodes))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        (low_a, high_a), (low_b, high_b) = a.box(a0, a1), b.box(b0, b1)
        gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
        if gap @ gap > limit:
            continue
        if max(a1 - a0, b1 - b0) > SHORT:
            halves_a = [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)] if a1 - a0 > SHORT else [(a0, a1)]
            halves_b = [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)] if b1 - b0 > SHORT else [(b0, b1)]
            stack += [(*x, *y) for x in halves_a for y in halves_b if not same or x[0] <= y[0]]
            continue
        distance = a.squares[a0:a1, None] + b.squares[None, b0:b1] - 2 * (a.leading[a0:a1] @ b.leading[b0:b1].T)
        i, j = np.nonzero(distance <= limit)
        i, j = i + a0, j + b0
        if same:
            i, j = i[i < j], j[i < j]
        near = (a.units[i] * b.units[j]).sum(axis=1) >= threshold - SLACK
        i, j = i[near], j[near]
        x, y = a.vectors[i], b.vectors[j]
        cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        # Out of range squares fall back on the units.
        cosine = np.where(np.isfinite(cosine), cosine, (a.units[i] * b.units[j]).sum(axis=1))
        linked = cosine >= threshold
        if linked.any():
            found.append((i[linked], j[linked]))


def _joined(axes_sent, threshold: float):
    """Blocks, or pairs of them, to (node, links, root): links counted with copies, root within the pair."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                same = "block_b" not in row
                a = _Sequence(row, "a", axes_sent.value)
                b = a if same else _Sequence(row, "b", axes_sent.value)
                shift = 0 if same else len(a.nodes)
                nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
                links, labels = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                found: list[tuple[np.ndarray, np.ndarray]] = []
                _join(a, b, same, threshold, found)
                for i, j in found:
                    np.add.at(links, i, b.counts[j])
                    np.add.at(links, j + shift, a.counts[i])
                    labels = _union(labels, i, j + shift)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[at]), pa.array(links[at]), pa.array(nodes[labels[at]])], names=["node", "links", "root"]
                )

    return run


def _unpacked(blocks: DataFrame) -> DataFrame:
    """(node, vector, n, first) of every block's vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["nodes"], np.int64)
                values = pa.array(_numbers(row["vectors"], row["single"], len(nodes)).ravel())
                offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * row["length"])
                columns = [
                    pa.array(nodes),
                    pa.ListArray.from_arrays(offsets, values),
                    pa.array(np.frombuffer(row["counts"], np.int64)),
                    pa.array(row["firsts"], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "vector", "n", "first"])

    return map_arrow(
        blocks.select("nodes", "vectors", "counts", "firsts", "length", "single"), run, "node long, vector array<double>, n long, first long"
    )


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (block_a, block_b) of different blocks, each once, whose boxes are no further apart than epsilon.

    Blocks meet on the cells of the leading axes: one takes its own, the other the
    neighbours' too, so no pair of blocks is made that one of these axes keeps apart.
    """

    def cells(rows: DataFrame, more: int) -> DataFrame:
        for k in range(MEETING_AXES):
            low, high = (f"coalesce(CAST(floor(get({end}, {k}) / {epsilon!r}D) AS int), 0)" for end in ("low", "high"))
            cell = f"explode(sequence({low} - {more}, {high} + {more})) AS cell{k}"
            rows = rows.selectExpr("*", cell)
        return rows

    keys = [f"cell{k}" for k in range(MEETING_AXES)]
    ends = blocks.select("block", "length", "low", "high")
    one = cells(ends, 0)
    two = cells(ends, 1).withColumnsRenamed({c: f"{c}_b" for c in ("block", "length", "low", "high")})
    gaps = (
        "aggregate(zip_with(zip_with(low, high_b, (l, h) -> l - h), zip_with(low_b, high, (l, h) -> l - h), "
        "(x, y) -> greatest(x, y, 0D)), 0D, (s, g) -> s + g * g)"
    )
    near = one.join(two, keys).where("block < block_b AND length = length_b")
    near = near.where(f"{gaps} <= {epsilon * epsilon + SLACK!r}D")
    return near.select(F.col("block").alias("block_a"), "block_b").distinct()


def near_duplicates(
    vectors: DataFrame, threshold: float, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    ``n_links`` counts the other rows at a cosine of at least ``threshold``, and
    ``component_id`` is the smallest id reachable by links.
    """
    spark = vectors.sparkSession
    epsilon = math.sqrt(2 - 2 * threshold)
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    valid = rows.where(_valid("vector"))
    distinct = written(valid.groupBy("vector").agg(F.count("*").alias("n"), F.min("id").alias("first")), "vectors")
    axes = principal_axes(distinct)
    sent = spark.sparkContext.broadcast(axes)
    order = [F.size("vector"), *(F.get("cells", F.lit(k)) for k in range(GRID_AXES)), F.xxhash64("vector")]
    # The last key parts vectors of one cell, so that a crowded cell spans several tasks.
    celled = written(_with_cells(distinct, axes, epsilon), "cells")
    ordered = celled.repartitionByRange(*order).sortWithinPartitions(*order).select("vector", "n", "first")
    blocks = written(map_arrow(ordered, _cut(sent, block_rows), BLOCKS), "blocks")
    pairs = written(block_pairs(blocks, epsilon), "block-pairs")
    one, two = (blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in PARTS)) for s in "ab")
    tiles = pairs.join(one, "block_a").join(two, "block_b")
    # A row holds one block or two.
    with batch_rows(spark, 1):
        found = (map_arrow(rows, _joined(sent, threshold), "node long, links long, root long") for rows in (one, tiles))
        links = written(reduce(DataFrame.union, found), "vector-links")
    with batch_rows(spark, 1):
        nodes = written(_unpacked(blocks), "vector-nodes")
    members = connected(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = written(
        lookup(lookup(nodes, sums, ["node"]), members, ["node"])
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n") - 1),
        "vector-groups",
    )
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = lookup(grouped, lowest, ["component"], "inner").select("vector", "n_links", "component_id")
    found = lookup(rows, named, ["vector"], "left")
    linked = F.col("n_links").isNotNull()
    return found.select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id")))
