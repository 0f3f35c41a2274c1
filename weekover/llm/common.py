"""Small helpers shared by the operators: words, written tables, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.session import shared_folder

# What separates words (space, tab to carriage return), as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"

# Rows of a batch handed to Python. Texts can be long, and two workers share an executor.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of a batch handed to Python by the jobs started inside."""
    former = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, former)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe when executors are lost."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark, purpose)}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def words(column: str) -> F.Column:
    """Words of a text as an array; none for NULL."""
    return F.coalesce(F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(column: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def lowest(spot: F.Column, share: float) -> F.Column:
    """Whether a 64-bit hash is among the lowest ``share`` of all hashes, however small the share is."""
    return F.lit(True) if share >= 1 else spot < F.lit(int(share * 2.0**64) - 2**63)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed or sent along; this helps where only the driver's
    path knows it, and sets the rows of a batch.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def map_arrow(frame: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    reach_workers(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def fresh(frame: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, whatever its letters' case."""
    taken = {c.lower() for c in frame.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_columns(
    frame: DataFrame,
    make: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    inputs: list[str],
    added: dict[str, T.DataType],
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns (all if not given) with columns that ``make`` computes batch by batch.

    ``make`` gets the columns ``inputs`` by position and is called in tasks. An added
    column replaces one of its name.
    """
    kept = [c for c in (frame.columns if keep is None else keep) if c.lower() not in {a.lower() for a in added}]
    schema = T.StructType(
        [T.StructField(c, frame.schema[c].dataType, True) for c in kept]
        + [T.StructField(c, kind, True) for c, kind in added.items()]
    )
    n_kept = len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            source = pa.RecordBatch.from_arrays(batch.columns[n_kept:], names=inputs)
            new = make(source)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_kept], *(new[c] for c in added)], names=[*kept, *added]
            )

    passed = frame.select(
        *(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs))
    )
    return map_arrow(passed, run, schema)


def lookup(frame: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join with a table of one row per key, so that a hot key of ``frame`` can be split.

    Where the table is an aggregate on the same keys, Spark would join on its partitioning
    and could not split a hot key at run time. The hash as a further key makes both sides
    ordinary shuffles.
    """
    mark = fresh(frame, "key_hash")
    hashed = F.xxhash64(*(F.col(f"`{k}`") for k in keys)).alias(mark)
    right = table.select("*", hashed)
    joined = frame.select("*", hashed).join(right, [*keys, mark], how)
    others = [] if how in ("left_semi", "left_anti") else [c for c in table.columns if c not in keys]
    return joined.select(*(F.col(f"`{c}`") for c in [*frame.columns, *others]))
