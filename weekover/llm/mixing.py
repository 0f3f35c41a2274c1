"""Mixing sources to target weights by capped water-filling.

Each source is to give its weight's share of the mix, but no more than ``epochs`` times
its own size. Sources whose share is above that are clamped, and what they cannot give is
shared among the others by weight, until no share is too large. A source's target then
says how often each of its documents is taken: whole repetitions for all, and one more for
a seeded part of them.

The smaller side of each source is picked: the documents that are taken once more, or, if
those are more than half of its words, the ones that are not. It is found in rounds. A
round goes through the documents of at most half of what the side misses by their seeded
draws, from where the round before ended, and picks all below a threshold, where the next
one would be too much. Documents that are too large stay out and smaller ones behind them
come in, so what is missing at least halves in each round until no such document is left;
then the largest further document that fits is picked. In the end less is missing than the
smallest document of the other side. A threshold is found by two histograms of the draws,
each of ``BINS`` bins per source, and the few draws of one bin of the second, so no task
ever sees the rows of a source together. Whole documents are taken, so reruns and lost
executors give the same mix.

Only DataFrame functions are used. NULL texts have size 0. A NULL source is a source like
any other and comes last. Rows with the same id and text draw alike
and are taken together. Texts count whole, whatever their length. An empty table gives an
empty mix. ``mix`` leaves other columns out; ``repeated`` passes them all through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.llm.common import fresh, word_count, written

BINS = 4096
# Draws are whole numbers below this, so many that hardly any two documents draw alike.
DRAWS = BINS**5
# Draws in a bin of the first histogram, of the second, and single draws.
WIDTHS = (BINS**4, BINS**3, 1)
SEED = 20


def rotating_weights(sources: DataFrame, weights: int = 3) -> DataFrame:
    """Sources by code point, NULL last, weigh 1, 2, ... and again; one row per source."""
    order = "row_number() OVER (ORDER BY source IS NULL, source) - 1"
    return sources.selectExpr("source", f"CAST(({order}) % {weights} + 1 AS double) AS weight")


def targets(sources: DataFrame, epochs: float) -> DataFrame:
    """Adds ``target`` to sources (source_size, weight): what each should give.

    In the order of cap per weight the clamped sources come first. With the sources before
    one clamped, the others share what is left at one level; the first source whose cap
    holds that level ends the clamping. The targets add up to all sizes unless every source
    is clamped. Sources without weight or size get none. The driver sees two numbers.
    """
    cap = f"CAST(source_size * {float(epochs)!r}D AS double)"
    order = "ORDER BY cap / weight, weight, cap ROWS BETWEEN"
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    ranked = sources.where("weight > 0").selectExpr("weight", f"{cap} AS cap").selectExpr(
        "cap / weight AS holds",
        f"({float(total)!r}D - coalesce(sum(cap) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0D))"
        f" / sum(weight) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level",
    )
    # Clamping a source that holds the level only lowers it, so the first of the levels is the
    # highest. If none holds, all are clamped.
    level = ranked.where("holds >= level").agg(F.max("level")).first()[0]
    aimed = "cap" if level is None else f"least(cap, weight * {level!r}D)"
    own = [f"`{c}`" for c in sources.columns]
    return sources.selectExpr("*", f"{cap} AS cap").selectExpr(
        *own, f"CASE WHEN weight > 0 THEN {aimed} ELSE 0D END AS target"
    )


def draw(doc_id: str, text: str) -> F.Column:
    """A seeded whole number below ``DRAWS`` for a row."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(SEED)), F.lit(DRAWS))


def _crossing(rows: DataFrame, width: int) -> DataFrame:
    """Per source the bin of ``width`` draws in which the running sum of sizes passes ``rest``, and the rest before it."""
    sums = rows.groupBy("source_key", "rest", F.expr(f"draw div {width}").alias("bin")).agg(F.sum("size").alias("size"))
    running = "sum(size) OVER (PARTITION BY source_key ORDER BY bin)"
    passed = sums.selectExpr("*", f"{running} AS run").where("run > rest")
    first = passed.groupBy("source_key").agg(F.expr("min_by(struct(bin, rest - (run - size) AS rest), bin) AS c"))
    return first.select("source_key", "c.bin", "c.rest")


def _filled(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """``edge`` after one round: a further part of the draws, where the next begins, and what is missing then."""
    given = edge.selectExpr("source_key", "start", "missing AS rest", "floor(missing / 2) AS most")
    fit = rows.join(given, "source_key").where("draw >= start AND size > 0 AND size <= most")
    fit = fit.select("source_key", "draw", "size", "rest")
    crossed = _crossing(fit, WIDTHS[0])
    for wide, width in zip(WIDTHS, WIDTHS[1:]):
        inside = fit.drop("rest").withColumn("bin", F.expr(f"draw div {wide}")).join(crossed, ["source_key", "bin"])
        crossed = _crossing(inside.drop("bin"), width)
    total = fit.groupBy("source_key").agg(F.sum("size").alias("total"))
    part = f"struct(start AS low, coalesce(bin, {DRAWS}L) AS high, floor(missing / 2) AS most)"
    return edge.join(total, "source_key", "left").join(crossed, "source_key", "left").selectExpr(
        "source_key",
        "whole",
        "others",
        f"if(total > 0, array_append(parts, {part}), parts) AS parts",
        # The document at the crossing is larger than what is missing now.
        f"coalesce(bin + 1, {DRAWS}L) AS start",
        "coalesce(rest, missing - coalesce(total, 0L)) AS missing",
    )


# Whether a row is in one of the parts of its source.
IN_PARTS = "exists(parts, p -> draw >= p.low AND draw < p.high AND size <= p.most)"


def plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: whole repetitions, parts of the draws with their largest sizes, and the one further draw and size.

    Those are the documents taken once more, or all others are, if ``others`` is true.
    ``rows`` has (source_key, size, draw) of every document, ``sources`` (source_key,
    source_size, target). The driver sees one count per round.
    """
    goal = "if(source_size > 0, target - floor(target / source_size) * source_size, 0D)"
    edge = sources.selectExpr(
        "source_key",
        "if(source_size > 0, floor(target / source_size), 0L) AS whole",
        f"{goal} > source_size / 2 AS others",
        "CAST(array() AS array<struct<low: bigint, high: bigint, most: bigint>>) AS parts",
        "0L AS start",
        f"least({goal}, source_size - {goal}) AS missing",
    )
    edge = written(edge, "edges")
    # Ends: what is missing halves, or all documents of a source have been gone through.
    while edge.where(f"start < {DRAWS}L AND missing >= 2").count():
        edge = written(_filled(rows, edge), "edges")
    left = rows.join(edge, "source_key").where(f"size > 0 AND size <= missing AND NOT {IN_PARTS}")
    alike = left.groupBy("source_key", "missing", "draw", "size").agg(F.sum("size").alias("together"))
    best = alike.where("together <= missing").groupBy("source_key").agg(
        F.min(F.struct(F.expr("missing - together").alias("off"), "draw", "size")).alias("b")
    )
    return written(
        edge.join(best, "source_key", "left").selectExpr(
            "source_key", "whole", "others", "parts", "b.draw AS last_draw", "b.size AS last_size"
        ),
        "mix",
    )


def source_key(source: str) -> F.Column:
    """Names a source, NULL too, by a text that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def copies() -> F.Column:
    """How often a row with (size, draw) is taken under its source's plan."""
    picked = f"coalesce({IN_PARTS} OR draw = last_draw AND size = last_size, false)"
    return F.expr(f"CAST(whole + if(size > 0 AND {picked} <> others, 1, 0) AS bigint)")


def measured(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source_key, size, draw) of every row, written once so that texts are read once."""
    return written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            source_key(source).alias("source_key"),
            word_count(text).alias("size"),
            draw(doc_id, text).alias("draw"),
        ),
        "measured",
    )


def mix(
    docs: DataFrame,
    epochs: float = 3.0,
    weights: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The measured rows with (source_size, target, copies), and the plan of each source.

    ``weights`` has (source, weight) for every source; without it sources rotate through
    1, 2 and 3. One row per source is assumed to be small.
    """
    rows = measured(docs, doc_id, text, source)
    sizes = rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weights = rotating_weights(sizes.select("source"))
    keyed = weights.select(source_key("source").alias("source_key"), "weight")
    weighted = written(sizes.join(keyed, "source_key"), "sources")
    aimed = written(targets(weighted, epochs).select("source_key", "source_size", "target"), "targets")
    planned = plan(rows, aimed)
    mixed = rows.join(aimed.join(planned, "source_key"), "source_key").withColumn("copies", copies())
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies"), planned


def repeated(
    docs: DataFrame, epochs: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    _, planned = mix(docs, epochs, None, doc_id, text, source)
    own = docs.columns
    key = fresh(docs, "source_key")
    drawn = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"),
        source_key(source).alias(key),
        word_count(text).alias("size"),
        draw(doc_id, text).alias("draw"),
    )
    taken = drawn.join(planned.withColumnRenamed("source_key", key), key).withColumn("copies", copies())
    return taken.where("copies > 0").select(F.col("row"), F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
