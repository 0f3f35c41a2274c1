"""Connected components of links that are too many for one machine.

Alternating large-star and small-star rounds: the first hangs the larger neighbours of a
node on its smallest one, the second the smaller ones, until every component is a star
around its smallest node. Each round is written to the shared folder, so plans stay short
and a lost executor costs one round at most. The driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.llm.common import lookup, written

# Rounds grow with the logarithm of the longest chain; beyond this something is wrong.
ROUNDS = 100


def _stars(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the smallest of each node ``a`` and its neighbours ``b``."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return lookup(pairs, least, ["a"], "inner")


def _round(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = _stars(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    small = _stars(large)
    # A node hangs on its smallest neighbour, and so do the other smaller ones.
    hung = "explode(array(struct(a, low AS b), struct(b AS a, low AS b))) AS link"
    return small.selectExpr(hung).select("link.*").where("a > b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links ``a``, ``b``; the component is its smallest node.

    Links are longs in either direction; repeated ones, links of a node with itself and
    links with NULL change nothing.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.where("a > b").distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        state = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before or state[0] == 0:
            break
        before = state
        links = written(_round(links), "links")
    else:
        raise RuntimeError("components did not settle")
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(links.select("b", "b").distinct().toDF("node", "component"))
