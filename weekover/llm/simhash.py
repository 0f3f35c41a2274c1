"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint has bit k set if more than half of the shingle hashes have. Fingerprints
that differ in at most ``distance`` bits are linked.

Search: ``distance + 1`` masks divide the bits, so linked fingerprints agree on one mask
at least. All fingerprints with the same bits under a mask form a node of the index and
meet in one task; a node that holds too many is divided again by masks over the bits it
does not share yet, down to ``LEAST_FREE`` free bits, which bounds any node. Inside a task
the fingerprints of a node are sorted by Gray rank, which keeps similar ones together; the
tree above them stores for every run of the order the bits that its members share. Two
runs are compared before their members are: bits that both share and that differ add up
while descending, and pairs of runs beyond the distance are dropped whole, as are runs
that are connected already. A node yields a spanning forest of its links, never all pairs.

NULL and empty texts have the fingerprint zero, which links like any other. Texts are read
whole, whatever their length. Repeated rows and equal texts share a fingerprint and so a
group, and a NULL id is kept but names none. An empty table gives an empty result. Other
columns pass through ``deduplicated`` and are left out of ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.llm.components import connected
from weekover.llm.common import fresh, lookup, map_arrow, with_columns, written

BITS = 64
SEED = 42
# Fingerprints of a node that one task takes, unless only LEAST_FREE bits are left.
NODE_ROWS = 1 << 14
LEAST_FREE = 20
# Fingerprints, and pairs of runs, that a task looks at together.
CHUNK_ROWS, CHUNK_PAIRS = 1 << 16, 1 << 12
# Bits between two levels of the tree.
STEP = 4


def fingerprint(text: str | None, shingle_words: int) -> int:
    """Fingerprint of a whole text as a signed long; zero without words.

    Words are what spaces and ASCII control blanks separate, with A-Z in lower case. A text
    of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle_words + 1)
    shingles = map(b" ".join, zip(*(words[k : k + count] for k in range(min(shingle_words, len(words))))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, count, 1 << 14):
        part = hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, BITS // 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def with_fingerprint(
    docs: DataFrame, shingle_words: int, text: str = "text", output: str = "fingerprint", keep: list[str] | None = None
) -> DataFrame:
    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [fingerprint(x.as_py(), shingle_words) for x in batch.column(0)]
        return {output: pa.array(found, pa.int64())}

    return with_columns(docs, make, [text], {output: T.LongType()}, keep)


def _masks(fixed: int, parts: int) -> list[int]:
    """The mask ``fixed`` with each of ``parts`` groups of the other bits added."""
    free = [k for k in range(BITS - 1, -1, -1) if not fixed >> k & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [fixed | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _nodes(rows: DataFrame, fixed: list[int], parts: int) -> tuple[DataFrame, list[int]]:
    """Each fingerprint in its nodes one level below the masks ``fixed``."""
    below = {mask: _masks(mask, parts) for mask in fixed}
    masks = F.lit(None).cast("array<bigint>")
    for mask, children in below.items():
        listed = F.array(*(F.lit(_signed(m)).cast("bigint") for m in children))
        masks = F.when(F.col("fixed") == F.lit(_signed(mask)), listed).otherwise(masks)
    rows = rows.select("fp", F.explode(masks).alias("fixed"))
    nodes = rows.withColumn("pattern", F.col("fp").bitwiseAND(F.col("fixed")))
    return nodes, [m for children in below.values() for m in children]


def gray_rank(column: str) -> F.Column:
    """Place of a fingerprint in the Gray code, as a long in signed order."""
    rank = column
    for shift in (1, 2, 4, 8, 16, 32):
        # The one-entry array evaluates the inner expression once.
        rank = f"transform(array({rank}), r -> r ^ shiftrightunsigned(r, {shift}))[0]"
    return F.expr(rank).bitwiseXOR(F.lit(-(1 << (BITS - 1))).cast("bigint"))


def _runs(groups: np.ndarray, fps: np.ndarray, width: int) -> np.ndarray:
    """Starts of the runs of one group whose members share the first ``width`` bits."""
    top = fps >> np.uint64(BITS - width) if width else np.zeros_like(fps)
    new = np.ones(len(fps), bool)
    new[1:] = (groups[1:] != groups[:-1]) | (top[1:] != top[:-1])
    return np.flatnonzero(new)


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        one, two = labels[a], labels[b]
        apart = one != two
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def forest(groups: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Root of each fingerprint in the components of its group.

    Both arrays are sorted by group, then Gray rank.
    """
    n = len(fps)
    widths = [*range(0, BITS + 1, STEP)]
    starts = [_runs(groups, fps, w) for w in widths]
    agreed, shared, first = [], [], []
    for k, at in enumerate(starts):
        every, some = np.bitwise_and.reduceat(fps, at), np.bitwise_or.reduceat(fps, at)
        agreed.append(~(every ^ some))
        shared.append(every & agreed[-1])
        # Runs of a level are made of whole runs of the next.
        first.append(np.append(np.searchsorted(starts[k + 1], at), len(starts[k + 1])) if k + 1 < len(starts) else None)
    labels = np.arange(n)
    roots = np.arange(len(starts[0]))
    stack = [(0, roots[i : i + CHUNK_PAIRS], roots[i : i + CHUNK_PAIRS]) for i in range(0, len(roots), CHUNK_PAIRS)]
    last = len(widths) - 1
    while stack:
        level, a, b = stack.pop()
        if level == last:
            # A run of equal fingerprints counts as one.
            labels = _union(labels, starts[last][a], starts[last][b])
            continue
        if level and len(a):
            low = np.minimum.reduceat(labels, starts[level])
            high = np.maximum.reduceat(labels, starts[level])
            open_ = ~((low[a] == high[b]) & (high[a] == low[b]))
            # A run of one member has no links inside.
            single = np.diff(np.append(starts[level], n)) == 1
            open_ &= ~((a == b) & single[a])
            a, b = a[open_], b[open_]
        below = first[level]
        wide_a, wide_b = below[a + 1] - below[a], below[b + 1] - below[b]
        pairs = wide_a * wide_b
        own = np.repeat(np.arange(len(a)), pairs)
        place = np.arange(len(own)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        child_a = below[a][own] + place // wide_b[own]
        child_b = below[b][own] + place % wide_b[own]
        level += 1
        differ = (shared[level][child_a] ^ shared[level][child_b]) & agreed[level][child_a] & agreed[level][child_b]
        near = (np.bitwise_count(differ) <= distance) & (child_a <= child_b)
        if level == last:
            near &= child_a < child_b
        child_a, child_b = child_a[near], child_b[near]
        # Taken last to first: distant pairs wait until the close ones are connected.
        order = np.argsort(child_a - child_b, kind="stable")
        child_a, child_b = child_a[order], child_b[order]
        for i in range(0, len(child_a), CHUNK_PAIRS):
            stack.append((level, child_a[i : i + CHUNK_PAIRS], child_b[i : i + CHUNK_PAIRS]))
    return labels


def _spanning(distance: int):
    """A task's part: rows (fixed, pattern, fp) in order of node and Gray rank to forest links."""

    def links(fixed: np.ndarray, pattern: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fps), bool)
        new[1:] = (fixed[1:] != fixed[:-1]) | (pattern[1:] != pattern[:-1])
        labels = forest(np.cumsum(new), fps.view(np.uint64), distance)
        members = np.flatnonzero(labels != np.arange(len(fps)))
        found = [pa.array(fps[members]), pa.array(fps[labels[members]])]
        return pa.RecordBatch.from_arrays(found, names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                fixed, pattern, fps = (np.concatenate(c) for c in zip(*held))
                # The last node may go on in the next batch.
                others = np.flatnonzero((fixed != fixed[-1]) | (pattern != pattern[-1]))
                if len(others):
                    cut = others[-1] + 1
                    yield links(fixed[:cut], pattern[:cut], fps[:cut])
                    held, rows = [[fixed[cut:], pattern[cut:], fps[cut:]]], rows - cut
                else:
                    held = [[fixed, pattern, fps]]
        if rows:
            yield links(*(np.concatenate(c) for c in zip(*held)))

    return run


def forest_links(fingerprints: DataFrame, distance: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` as near as ``distance``."""
    parts = distance + 1
    rows, masks = _nodes(fingerprints.withColumn("fixed", F.lit(0).cast("bigint")), [0], parts)
    done = None
    while True:
        free = BITS - min(m.bit_count() for m in masks)
        if free > LEAST_FREE:
            sizes = rows.groupBy("fixed", "pattern").count().where(F.col("count") > node_rows)
            large = written(sizes.select("fixed", "pattern"), "large-nodes")
        if free <= LEAST_FREE or large.isEmpty():
            done = rows if done is None else done.union(rows)
            break
        small = lookup(rows, large, ["fixed", "pattern"], "left_anti").select("fixed", "pattern", "fp")
        done = small if done is None else done.union(small)
        rows, masks = _nodes(lookup(rows, large, ["fixed", "pattern"], "left_semi"), masks, parts)
        rows = rows.select("fixed", "pattern", "fp")
    ordered = (
        done.select("fixed", "pattern", "fp")
        .repartition("fixed", "pattern")
        .withColumn("rank", gray_rank("fp"))
        .sortWithinPartitions("fixed", "pattern", "rank")
        .select("fixed", "pattern", "fp")
    )
    return map_arrow(ordered, _spanning(distance), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle_words: int, distance: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: its id, ``text_hash``, ``fingerprint``, ``grp`` and ``component_id``.

    ``grp`` names the component by its smallest fingerprint, ``component_id`` by its
    smallest id (NULL if no member has one). NULL and empty texts have fingerprint zero and
    are linked like any other; repeated rows stay.
    """
    # Taken from the text natively; tells apart rows that share an id.
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = written(
        with_fingerprint(narrow, shingle_words, output="fp", keep=["doc_id", "text_hash"]), "fingerprints"
    )
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    members = connected(forest_links(firsts.select("fp"), distance)).toDF("fp", "grp")
    linked = written(lookup(firsts, members, ["fp"], "left").withColumn("grp", F.coalesce("grp", "fp")), "grouped")
    lowest = linked.groupBy("grp").agg(F.min("first").alias("component_id"))
    named = lookup(linked, lowest, ["grp"], "inner").select("fp", "grp", "component_id")
    return lookup(rows, named, ["fp"], "inner").select(
        F.col("doc_id").alias(doc_id),
        "text_hash",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "grp",
        "component_id",
    )


def deduplicated(docs: DataFrame, shingle_words: int, distance: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id."""
    rows = written(near_duplicates(docs, shingle_words, distance, doc_id, text), "near-duplicates")
    key = fresh(docs, "row_key")
    # A struct is never NULL, so one key serves the join and the removal of repeated rows,
    # and the texts are shuffled once. Both sides have the same type, nullability included.
    kind = f"struct<unnamed:boolean,id:{docs.schema[doc_id].dataType.simpleString()},text_hash:bigint>"
    fields = f"`{doc_id}` IS NULL AS unnamed, `{doc_id}` AS id, {{text_hash}} AS text_hash"
    own = F.expr(f"CAST(struct({fields.format(text_hash='text_hash')}) AS {kind})").alias(key)
    winners = rows.select("grp", own).groupBy("grp").agg(F.min(key).alias(key)).select(key).distinct()
    marked = docs.withColumn(key, F.expr(f"CAST(struct({fields.format(text_hash=f'xxhash64(`{text}`)')}) AS {kind})"))
    return marked.join(winners, key, "left_semi").dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns))
