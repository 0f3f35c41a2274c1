"""URL filters by a sort-merge range join.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and all
paths that begin so. In the canonical key the labels of the host come in reverse, each with
a closing mark, so a rule's host and its subdomains are one interval of keys. Rules and urls
are sorted by these keys, and one sweep keeps a stack of the hosts whose intervals are open,
each nested in the one below. The path rules of an open host hang below it in order, each
with the longest rule that it continues, so the longest one that fits a path is found by
bisection. The longest fitting rule over the stack gives the verdict.

The order of keys is cut into buckets at keys of a bounded sample, which decides only how
even they are. A url's key ends with its hash, so a popular host is cut into several buckets
too; a rule goes to all buckets that its interval meets. Urls are taken once however many
pages share them. A task holds the rules of the open hosts, which are as many as a url has
labels.

NULL urls and urls without ``://`` have an empty host and path and match no rule but one
for the empty host; urls of any length are read whole. A rule given twice counts once, and
blocks if one of the two does. Of rules of equal length the one for the longer host wins.
NULL hosts or paths of rules count as empty; rules without a verdict are left out. Repeated
pages are judged each; without pages the result is empty, without rules all get the default.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.llm.common import BATCH_ROWS, fresh, lookup, map_arrow

# Urls of a bucket, most buckets (a square, as bounds are looked up in two steps), and keys
# that are sampled for each bound.
BUCKET_URLS, MOST_BUCKETS, SAMPLED = 4096, 128 * 128, 8
# Characters of a bound; a shorter one is a bound as well.
BOUND_CHARS = 200
DEFAULT = "allow"
# Closes a label, and stands before the hash of a url.
CLOSE, END = "\u0001", "\u0000"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Adds the host in lower case (A-Z only) and the path; both empty if there is no ``://``."""
    rest = f"if(instr(`{url}`, '://') > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')"
    raw, left = fresh(pages, "raw_host"), fresh(pages, "url_rest")
    split = pages.withColumn(left, F.coalesce(F.expr(rest), F.lit(""))).withColumn(
        raw, F.regexp_extract(left, r"^[^/?#]*", 0)
    )
    return (
        split.withColumn(host, F.translate(raw, UPPER, LOWER))
        .withColumn(path, F.regexp_extract(F.expr(f"substring(`{left}`, char_length(`{raw}`) + 1)"), r"^[^?#]*", 0))
        .drop(left, raw)
    )


def reversed_host(host: str) -> F.Column:
    """Labels from the top domain down, each with a closing mark; marks in labels are written otherwise."""
    plain = F.col(host)
    for mark, name in (("\u0002", "c"), (CLOSE, "b"), (END, "a")):
        plain = F.replace(plain, F.lit(mark), F.lit("\u0002" + name))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), CLOSE), F.lit(CLOSE))


class _Paths:
    """The path rules of one host, in order; each knows the longest other one that begins it."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.rules = sorted(rules)
        self.paths = [path for path, _, _ in self.rules]
        self.outer: list[int] = []
        open_rules: list[int] = []
        for k, path in enumerate(self.paths):
            while open_rules and not path.startswith(self.paths[open_rules[-1]]):
                open_rules.pop()
            self.outer.append(open_rules[-1] if open_rules else -1)
            open_rules.append(k)

    def longest(self, path: str) -> tuple[str, str, str] | None:
        # The last rule not behind the path, or one that it continues.
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.outer[k]
        return self.rules[k] if k >= 0 else None


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, key, url, host, path, verdict) in order, rules without url, to (url, rule, verdict)."""
    names = ["url", "rule", "verdict"]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    found: list[tuple] = []
    for _, bucket in groupby(rows(), key=lambda r: r[0]):
        # Open hosts, each one's key beginning with that of the one below.
        active: list[tuple[str, int, _Paths]] = []
        for key, group in groupby(bucket, key=lambda r: r[1]):
            while active and not key.startswith(active[-1][0]):
                active.pop()
            rules = []
            for _, _, url, host, path, verdict in group:
                if url is None:
                    rules.append((path, host + path, verdict))
                    continue
                fits = [(len(rule[1]), n, *rule[1:]) for _, n, paths in active if (rule := paths.longest(path))]
                if fits:
                    found.append((url, *max(fits)[2:]))
            if rules:
                active.append((key, key.count(CLOSE), _Paths(rules)))
            if len(found) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=names)
                found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=names)


def bounds_of(keyed: DataFrame, buckets: int | None) -> list[str]:
    """Keys that begin a new bucket, in order."""
    if buckets is None:
        buckets = min(MOST_BUCKETS, -(-keyed.count() // BUCKET_URLS))
    if buckets < 2:
        return []
    # A bounded sample: the lowest hashes.
    rows = keyed.orderBy(F.xxhash64("url", F.lit("bound")), "url").limit(SAMPLED * buckets)
    keys = [r[0] for r in rows.select(F.substring("key", 1, BOUND_CHARS)).collect()]
    keys.sort(key=lambda k: k.encode())
    return list(dict.fromkeys(keys[len(keys) * k // buckets] for k in range(1, buckets) if keys))


def _bucket(bounds: list[str], reached) -> F.Column:
    """How many bounds ``reached`` holds for; those are the first ones. Looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    array = lambda part: F.array(*map(F.lit, part))
    whole = F.size(F.filter(array([part[-1] for part in parts]), reached))
    rest = F.get(F.array(*map(array, parts)), whole)
    return whole * step + F.coalesce(F.size(F.filter(rest, reached)), F.lit(0)) - F.when(
        whole == len(parts), F.lit(step * len(parts) - len(bounds))
    ).otherwise(0)


def longest_rules(urls: DataFrame, rules: DataFrame, buckets: int | None = None) -> DataFrame:
    """(url, rule, verdict) of the urls (url, host, path), each given once, that some rule fits."""
    given = (
        rules.where("verdict IS NOT NULL")
        .select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", reversed_host("host"))
    )
    keyed = urls.withColumn("key", F.concat(reversed_host("host"), F.lit(END), F.hex(F.xxhash64("url"))))
    bounds = bounds_of(keyed, buckets)
    first = _bucket(bounds, lambda b: b <= F.col("key"))
    last = _bucket(bounds, lambda b: (b <= F.col("key")) | F.startswith(b, F.col("key")))
    probes = keyed.select(first.cast("int").alias("bucket"), "key", "url", "host", "path", F.lit(None).cast("string").alias("verdict"))
    spread = given.select(
        F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("bucket"),
        "key",
        F.lit(None).cast("string").alias("url"),
        "host",
        "path",
        "verdict",
    )
    ordered = probes.union(spread).repartition("bucket").sortWithinPartitions("bucket", "key")
    return map_arrow(ordered, _sweep, "url string, rule string, verdict string")


def judged(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, buckets: int | None = None
) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict``; existing columns of these names are replaced."""
    added = {"host", "path", "rule", "verdict"}
    own = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in added))
    named = with_host_and_path(own, url)
    each = named.select(F.col(url).alias("url"), "host", "path").where(F.col("url").isNotNull()).distinct()
    return lookup(named, longest_rules(each, rules, buckets).withColumnRenamed("url", url), [url], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default))
    )
