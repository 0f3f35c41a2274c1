"""Vector code compression with an equal-average search.

Vectors become integers and are cut into consecutive parts; each part position has a
codebook, and a vector is stored as the indexes of its parts' nearest entries. The search
for the nearest entry sorts the entries by the sum of their components and expands outward
from the part's own sum, the nearer side first. The squared gap of the sums over the number
of dimensions is a lower bound of the squared distance, so a part is done as soon as that
bound strictly exceeds the best distance found; an equal one may still be a tie of a lower
index. All parts of a batch expand in step. All arithmetic is on integers and exact.

Codebooks start as the parts of the vectors with the smallest ids and are refined in rounds:
tasks add up the parts assigned to each entry, Spark adds up the tasks' sums, and the driver
sees the entries' sums and counts alone.

NULL vectors and vectors with NULL or non-finite components are dropped. Vectors of different
lengths have codebooks of their own; a length that is no multiple of the number of parts
gives the first parts one component more, and parts without components have index 0. Fewer
vectors than entries make a smaller codebook. Among equal ids the lesser vector comes first,
NULL ids come last. Repeated rows count as often as they occur. An empty table gives an empty
result. Other columns pass through; one with the name of a result is replaced. Components
beyond ``vectors.LARGEST`` and an error that does not fit a long are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.llm import vectors as V
from weekover.llm.common import fresh, map_arrow, with_columns

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
# The entries of each part position, for each length of vectors.
Books = dict[int, list[np.ndarray]]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part, ties to the lower index."""
    m, width = parts.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    own = parts.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    best = np.full(m, -1)
    distance = np.zeros(m, parts.dtype)
    going = np.arange(m)
    while len(going):
        l, r, middle = left[going], right[going], own[going]
        has_left, has_right = l >= 0, r < len(sums)
        gap_left = middle - sums[np.maximum(l, 0)]
        gap_right = sums[np.minimum(r, len(sums) - 1)] - middle
        to_left = has_left & (~has_right | (gap_left <= gap_right))
        gap = np.where(to_left, gap_left, gap_right)
        at = np.where(to_left, l, r)
        more = (has_left | has_right) & ((best[going] < 0) | (gap * gap <= distance[going] * width))
        going, at, to_left = going[more], at[more], to_left[more]
        entry = order[at]
        off = parts[going] - entries[entry]
        new = (off * off).sum(axis=1)
        if not width:
            new = np.zeros(len(going), parts.dtype)
        held = best[going]
        better = (held < 0) | (new < distance[going]) | ((new == distance[going]) & (entry < held))
        best[going[better]] = entry[better]
        distance[going[better]] = new[better]
        left[going[to_left]] -= 1
        right[going[~to_left]] += 1
    return best, distance


def _cuts(length: int, parts: int) -> list[slice]:
    widths = [length // parts + (k < length % parts) for k in range(parts)]
    ends = np.cumsum(widths).tolist()
    return [slice(end - width, end) for end, width in zip(ends, widths)]


def _safe(length: int) -> int:
    """Integers up to this keep every distance times a width within 64 bits."""
    return (1 << 29) // max(length, 1)


def _integers(vectors: np.ndarray, books: list[np.ndarray], scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Vectors and entries of one kind: 64-bit integers if all are small, Python's if not."""
    limit = _safe(vectors.shape[1])
    x = V.floored(vectors, scale, limit)
    if x.dtype != object and all(abs(b).max(initial=0) <= limit for b in books):
        return x, [b.astype(np.int64) for b in books]
    return V.wide(x), books


def _first(frame: DataFrame, vec_id: str, embedding: str, scale: int, parts: int, entries: int) -> Books:
    """The parts of the vectors with the smallest ids of each length."""
    ids, vector = F.col(f"`{vec_id}`").alias("id"), V.doubles(frame, embedding).alias("vector")
    finite = "vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < DOUBLE('Infinity'))"
    valid = frame.select(ids, vector).where(finite)
    lengths = [r[0] for r in valid.groupBy(F.size("vector")).agg(F.count("*")).limit(V.LENGTHS + 1).collect()]
    V.check_lengths(lengths, lambda n: n * entries)
    books: Books = {}
    for n in sorted(lengths):
        rows = valid.where(F.size("vector") == n).orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
        x = V.wide(V.floored(np.array([r["vector"] for r in rows], float).reshape(len(rows), n), scale, 0))
        books[n] = [x[:, cut] for cut in _cuts(n, parts)]
    return books


def fitted(
    frame: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Books:
    """Codebooks after ``rounds`` of assigning all parts and moving each entry to the floor of its parts' mean."""
    books = _first(frame, vec_id, embedding, scale, parts, entries)
    for _ in range(rounds if books else 0):
        books = _moved(frame, embedding, scale, books)
    return books


def _moved(frame: DataFrame, embedding: str, scale: int, books: Books) -> Books:
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, vectors in V.matrices(batch.column(0)):
                n = vectors.shape[1]
                x, own = _integers(vectors, books[n], scale)
                for k, cut in enumerate(_cuts(n, len(own))):
                    index, _ = nearest(x[:, cut], own[k])
                    added = np.zeros((len(own[k]), cut.stop - cut.start), x.dtype)
                    np.add.at(added, index, x[:, cut])
                    counts[n, k] = counts.get((n, k), 0) + np.bincount(index, minlength=len(own[k]))
                    sums[n, k] = sums.get((n, k), 0) + V.wide(added)
        for (n, k), total in sums.items():
            used = np.argwhere(np.broadcast_to(counts[n, k][:, None] > 0, total.shape))
            if len(used):
                entry, pos = used.T
                columns = [
                    pa.array(np.full(len(used), n), pa.int32()),
                    pa.array(np.full(len(used), k), pa.int32()),
                    pa.array(entry, pa.int32()),
                    pa.array(pos, pa.int32()),
                    pa.array(counts[n, k][entry], pa.int64()),
                    V.decimals(total[entry, pos]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["length", "part", "entry", "pos", "n", "total"])

    schema = "length int, part int, entry int, pos int, n long, total decimal(38,0)"
    parts = map_arrow(frame.select(V.doubles(frame, embedding)), partial, schema)
    moved = {n: [book.copy() for book in own] for n, own in books.items()}
    totals = parts.groupBy("length", "part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for row in totals.collect():
        moved[row["length"]][row["part"]][row["entry"], row["pos"]] = int(row["total"]) // row["n"]
    return moved


def encoded(
    frame: DataFrame, books: Books, embedding: str = "embedding", scale: int = SCALE, keep: list[str] | None = None
) -> DataFrame:
    """Adds ``code`` (an index per part) and ``error`` (squared distance to the entries) to every row that is not dropped."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        codes: list = [None] * batch.num_rows
        errors: list = [None] * batch.num_rows
        for at, vectors in V.matrices(batch.column(0)):
            if vectors.shape[1] not in books:
                continue
            x, own = _integers(vectors, books[vectors.shape[1]], scale)
            found = [nearest(x[:, cut], book) for cut, book in zip(_cuts(vectors.shape[1], len(own)), own)]
            index = np.stack([i for i, _ in found], axis=1).tolist()
            error = sum(V.wide(d) for _, d in found).tolist()
            for i, code, e in zip(at.tolist(), index, error):
                codes[i], errors[i] = code, e
        return {"code": pa.array(codes, pa.list_(pa.int32())), "error": pa.array(errors, pa.int64())}

    vector = fresh(frame, "vector")
    rows = frame.withColumn(vector, V.doubles(frame, embedding))
    added = {"code": T.ArrayType(T.IntegerType()), "error": T.LongType()}
    return with_columns(rows, make, [vector], added, frame.columns if keep is None else keep).where("code IS NOT NULL")


def decoded(books: Books, length: int, code: list[int]) -> list[int]:
    """The integers that a code of a vector of that length stands for."""
    return [int(x) for book, index in zip(books[length], code) for x in book[index]]


def digest(books: Books) -> str:
    """SHA-256 of all components by length, part, entry and position."""
    numbers = (str(x) for n in sorted(books) for book in books[n] for entry in book for x in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()
