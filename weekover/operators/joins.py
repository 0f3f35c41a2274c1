"""Joins that keep their freedom to be split at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(frame: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row per key, so that a hot key of ``frame`` can be split.

    An aggregate on the same keys would lend the join its partitioning, and Spark splits
    only sides that are plain shuffles. The hash as a further key makes both of them that.
    """
    mark = F.xxhash64(*keys).alias("lookup_hash")
    return frame.select("*", mark).join(table.select("*", mark), [*keys, "lookup_hash"], how).drop("lookup_hash")
