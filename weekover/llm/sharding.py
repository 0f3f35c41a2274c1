"""Sharding by minimax contiguous partition.

Documents with equal texts form one atomic group. Groups are ordered by the hash of their
text and cut into contiguous shards so that the largest shard is as small as possible: a
binary search finds the smallest level for which filling shards greedily in order takes
no more shards than there are, where a group above the level has a shard of its own. So a
group that no shard can divide does not set the size of all others. Below the level, each
shard is filled to an equal share of the bytes that are left, as far as the shards left
can hold the rest, and no shard stays empty while there are groups for it.

The order is summed up by the leading bits of the hash into at most ``2**RUN_BITS`` runs
of whole groups. Runs that decide something are divided by the next bits and the search is
repeated, until each of them is a single group: the runs on both sides of a cut, those that
do not fit at one byte below the level, and those above it. Then neither the level nor the
cuts would differ if every group were a run. The search runs as one SQL expression over these
arrays, which hold ``2**RUN_BITS`` entries and as many again for each divided run, a few for
each shard. Rows never meet by shard or by group: a row's slot is the count of rows in the
slots' classes before its own, plus its place in its class.

Only DataFrame functions are used. A NULL text has no bytes and is a group of its own
with the empty text; long texts count whole. NULL and repeated ids are rows like any other.
An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.llm.common import lookup, written

# Bits of the text hash that make a run; a run is divided by as many again.
RUN_BITS, HASH_BITS = 12, 64
# Every row counts as much beside its text's bytes.
ROW_BYTES = 16
# Least classes that the rows of a run are dealt to, so that no run is numbered by one task,
# and rows of the table for each class: a group that holds a third of them has smaller classes.
CLASSES, CLASS_ROWS = 64, 1 << 20
SEARCH_STEPS = 64


def sized(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id, size, checksum and place in the order of every row, without the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("spot"),
    )


def _beginning(bits: int) -> str:
    """The hash with all but its leading bits zero."""
    return f"shiftleft(shiftrightunsigned(spot, {HASH_BITS - bits}), {HASH_BITS - bits})"


def in_runs(rows: DataFrame, divided: dict[int, list[int]]) -> DataFrame:
    """Adds the run of every row: its beginning in the order of hashes, and its bits as ``part``.

    ``divided`` has the beginnings of the runs that are divided, by their bits.
    """
    depths = [min(bits, HASH_BITS) for bits in range(RUN_BITS, HASH_BITS + RUN_BITS, RUN_BITS)]
    part = F.lit(depths[-1])
    for bits in reversed(depths[:-1]):
        part = F.when(~F.expr(_beginning(bits)).isin(divided.get(bits, [])), F.lit(bits)).otherwise(part)
    beginning = F.expr("CASE part " + " ".join(f"WHEN {bits} THEN {_beginning(bits)}" for bits in depths) + " END")
    # With its first bit turned a hash is in the same order as a signed number.
    return rows.withColumn("part", part.cast("bigint")).withColumn("run", beginning.bitwiseXOR(F.expr("shiftleft(-1L, 63)")))


def runs_of(groups: DataFrame) -> DataFrame:
    """Size of every run, by (run, part); bounded by the bits."""
    return groups.groupBy("run", "part").agg(F.sum("size").alias("size"))


def listed(runs: DataFrame) -> DataFrame:
    """One row with all runs in order; they are bounded, so that they fit into one array."""
    return runs.agg(F.array_sort(F.collect_list(F.struct("run", "part", "size"))).alias("runs"))


def _searched(runs: DataFrame, n_shards: int) -> tuple[int, int]:
    """The smallest level at which greedy filling in order takes no more than ``n_shards``, and the largest run."""
    total = "aggregate(runs, 0L, (a, r) -> a + r.size)"
    # Shards that greedy filling takes at a level; a run above it is alone in its shard.
    taken = (
        "aggregate(runs, struct(1L AS shards, 0L AS used), (a, r) -> if(a.used > 0 AND a.used + r.size > b.mid, "
        "struct(a.shards + 1 AS shards, r.size AS used), struct(a.shards AS shards, a.used + r.size AS used)), "
        "a -> a.shards)"
    )
    halved = "struct({low} AS low, {high} AS high, ({low} + {high}) div 2 AS mid)"
    step = (
        f"if(b.low >= b.high, b, if({taken} <= {n_shards}, {halved.format(low='b.low', high='b.mid')}, "
        f"{halved.format(low='(b.mid + 1)', high='b.high')}))"
    )
    start = halved.format(low="0L", high=total)
    search = f"aggregate(sequence(1, {SEARCH_STEPS}), {start}, (b, i) -> {step}, b -> b.high)"
    largest = "aggregate(runs, 0L, (a, r) -> greatest(a, r.size))"
    found = listed(runs).selectExpr(f"{search} AS level", f"{largest} AS largest").first()
    return found["level"], found["largest"]


def capacity(runs: DataFrame, n_shards: int) -> int:
    """The smallest size of the largest shard."""
    return max(_searched(runs, n_shards))


def cuts(runs: DataFrame, n_shards: int) -> DataFrame:
    """Shard of every run, and whether it decides something: touches a cut, or keeps the level from being lower."""
    level, _ = _searched(runs, n_shards)
    # Where shards begin at one byte less; a shard too many is enough to tell.
    lower = (
        "aggregate(runs, struct(0 AS i, 0L AS used, CAST(array() AS array<int>) AS at), (a, r) -> "
        f"if(a.used > 0 AND a.used + r.size > {level - 1}L, struct(a.i + 1 AS i, r.size AS used, "
        f"if(size(a.at) > {n_shards}, a.at, array_append(a.at, a.i)) AS at), "
        "struct(a.i + 1 AS i, a.used + r.size AS used, a.at AS at)), a -> a.at)"
    )
    # Where the shards begin that greedy filling makes from the end, the last one first:
    # a shard with k shards behind it may not end before the k-th of these places.
    back = (
        "aggregate(reverse(runs), struct(size(runs) AS i, 0L AS used, CAST(array() AS array<int>) AS at), (a, r) -> "
        f"if(a.used > 0 AND a.used + r.size > {level}L, "
        "struct(a.i - 1 AS i, r.size AS used, array_append(a.at, a.i) AS at), "
        "struct(a.i - 1 AS i, a.used + r.size AS used, a.at AS at)), a -> a.at)"
    )
    # Bytes of the runs at or below the level, and the number of those above it.
    small = f"aggregate(runs, 0L, (a, r) -> a + if(r.size > {level}L, 0L, r.size))"
    alone = f"size(filter(runs, r -> r.size > {level}L))"
    # An equal share of the bytes left, for a shard that begins now as the ``nth``.
    share = f"CAST((small - a.gone) / greatest(1, {n_shards} - {{nth}} - (alone - a.big)) AS double)"
    behind = f"({n_shards} - 1 - size(a.at))"
    full = f"(a.used + r.size / 2 > a.aim OR size(runs) - a.i <= {behind})"
    ends = (
        f"a.used > 0 AND (a.used + r.size > {level}L OR "
        f"{behind} > 0 AND a.i >= coalesce(get(back, {behind} - 1), 0) AND {full})"
    )
    passed = f"a.gone + if(r.size > {level}L, 0L, r.size) AS gone, a.big + if(r.size > {level}L, 1, 0) AS big"
    next_shard = f"r.size AS used, {share.format(nth='(size(a.at) + 1)')} AS aim, array_append(a.at, a.i) AS at"
    same_shard = "a.used + r.size AS used, a.aim AS aim, a.at AS at"
    start = (
        f"struct(0 AS i, 0L AS gone, 0 AS big, 0L AS used, "
        f"CAST(small / greatest(1, {n_shards} - alone) AS double) AS aim, CAST(array() AS array<int>) AS at)"
    )
    # Places of the runs that begin a new shard.
    begun = (
        f"aggregate(runs, {start}, (a, r) -> if({ends}, struct(a.i + 1 AS i, {passed}, {next_shard}), "
        f"struct(a.i + 1 AS i, {passed}, {same_shard})), a -> a.at)"
    )
    each = listed(runs).selectExpr("runs", f"{back} AS back", f"{small} AS small", f"{alone} AS alone", f"{lower} AS lower")
    each = each.selectExpr(f"{begun} AS at", "runs", "lower").selectExpr("at", "lower", "posexplode(runs) AS (i, r)")
    decides = f"exists(at, c -> c = i OR c = i + 1) OR array_contains(lower, i) OR r.size > {level}L"
    return each.selectExpr("r.*", "size(filter(at, c -> c <= i)) AS shard", f"{decides} AS decides")


def shards(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, shard, slot).

    The largest shard is as small as whole groups allow, and the others share what is beside
    groups too large for an equal share. Slots of a shard run from 0 without gaps. Some
    shards stay empty if there are too few groups.
    """
    rows = written(sized(docs, doc_id, text), "sized")
    groups = written(rows.groupBy("spot").agg(F.sum("size").alias("size")), "groups")
    divided: dict[int, list[int]] = {}
    while True:
        runs = in_runs(groups, divided).groupBy("run", "part").agg(
            F.sum("size").alias("size"), F.count("*").alias("n_groups"), F.min("spot").alias("spot")
        )
        runs = written(runs, "runs")
        found = cuts(runs.select("run", "part", "size"), n_shards).where("decides").select("run", "part")
        # A few runs for each shard.
        open_runs = runs.where("n_groups > 1").join(found, ["run", "part"], "left_semi").select("part", "spot").collect()
        if not open_runs:
            break
        for row in open_runs:
            left = HASH_BITS - row["part"]
            beginning = (row["spot"] >> left) << left
            divided.setdefault(row["part"], []).append(beginning)
    n_classes = max(CLASSES, -(-rows.count() // CLASS_ROWS))
    classed = rows.withColumn("class", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_classes)))
    divided_rows = in_runs(classed, divided)
    sizes = divided_rows.groupBy("run", "part", "class").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sizes = written(sizes, "run-sizes")
    placed = cuts(runs_of(sizes), n_shards).select("run", "part", "shard")
    placed = written(placed, "placed-runs")
    before = "sum(n) OVER (PARTITION BY shard ORDER BY run, part, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    classes = sizes.join(placed, ["run", "part"]).selectExpr(
        "run", "part", "class", "shard", f"coalesce({before}, 0L) AS before"
    )
    numbered = divided_rows.selectExpr(
        "*", "row_number() OVER (PARTITION BY run, part, class ORDER BY spot, doc_id) - 1 AS place"
    )
    return lookup(numbered, classes, ["run", "part", "class"], "inner").select(
        F.col("doc_id").alias(doc_id),
        "size",
        "text_crc32",
        "shard",
        (F.col("before") + F.col("place")).cast("bigint").alias("slot"),
    )
