"""The hourly report from sums by second of the day, for a clock that moves.

What an order adds to an hour depends on which of its rows are taken: today those known at
the clock, last week those up to the same time of day as the latest order of today. Both are
beginnings of the order's rows in the order of their times. So each row's time is a step,
and an order adds at a step what its rows up to it give, less what its rows before it gave.
Added up over orders these steps are the partials of a cluster, day and hour; their running
sums are looked up at one second, and no order is read when the clock moves.

The rows of an order are added up by second first, exact copies counting once from the
earliest on, so an order of many rows is a group of at most 3600 seconds in an hour, twice
that with fractions of seconds.

Clocks are whole seconds. A row is known from the first whole second that is not before its
time, and reaches a cutoff by the second its time lies in. Rows without a time belong to
today at any clock and to last week never, as in the report over the rows.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.numeric import aliased, as_money, units
from weekover.operators import compare, facts, filters, spend
from weekover.params import ReportParams
from weekover.sources.inputs import ReportInputs

# Seconds of rows that are always known, and of rows that no cutoff reaches.
ALWAYS, NEVER = -1, 1 << 20
STEP = ("second", "known")
CELL = ("cluster", "dt", "hr")
# Whole numbers that add up: rows, orders, orders with a banner, money, and orders whose
# money is no amount.
MONEY = (*facts.AMOUNTS, "special_sum", "targeted_sum")
MEASURES = ("n_rows", "n_orders", "n_banner", *MONEY, *(f"{name}_bad" for name in facts.AMOUNTS))


def order_rows(orders: DataFrame, inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """Rows of the hourly report without exact copies, each with its steps.

    Neither day nor clock restrict them; ``params`` gives the clusters.
    """
    kept = orders.where("excluded_flag = 0").withColumn("hr", F.hour("created_on"))
    rows = filters.in_clusters(kept, inputs.cluster_dim, params)
    columns = facts.distinct_rows(rows).columns
    second = filters.second_of_day("created_on")
    fraction = "if(created_on > date_trunc('SECOND', created_on), 1, 0)"
    return (
        rows.groupBy(*columns)
        .agg(F.min("created_on").alias("created_on"))
        .selectExpr(
            *columns,
            f"coalesce({second}, {NEVER}) AS second",
            f"coalesce({second} + {fraction}, {ALWAYS}) AS known",
        )
    )


def _step_sums(rows: DataFrame, inputs: ReportInputs, weights: DataFrame, params: ReportParams) -> DataFrame:
    """The rows of an order added up by step: amounts, copies, and the spend of all of them in units."""
    nested = "offer_details" in rows.columns
    # As one struct the key is never NULL, so rows without an id or time join their spend.
    rows = rows.selectExpr("*", f"struct({', '.join((*facts.KEY, *STEP))}) AS step")
    coupons = spend.special_spend(rows, inputs.special_coupons)
    totals = {name: f"sum({amount})" for name, amount in facts.AMOUNTS.items()}
    totals |= {f"{name}_bad": f"count_if(({amount}) IS NULL)" for name, amount in facts.AMOUNTS.items()}
    totals |= {
        "copies": "count(*)",
        "banners": f"count_if(banner_factor > {params.banner_threshold}D)",
        "special_sum": f"sum({units('special_spend')})",
    }
    sums = coupons.groupBy("step").agg(*map(F.expr, aliased(totals)))
    if nested:
        spent = spend.nested_spend(rows, weights, ["step"])
        return sums.join(spent, "step", "left").selectExpr("step.*", "* EXCEPT (step)")
    spent = spend.order_spend(inputs.offer_lines, weights)
    return sums.selectExpr("step.*", "* EXCEPT (step)").join(spent, ["order_id", "dt"], "left").withColumn(
        "spend_units", F.expr("spend_units * copies")
    )


def partials(
    orders: DataFrame, inputs: ReportInputs, params: ReportParams, weights: DataFrame | None = None
) -> DataFrame:
    """Steps of all orders by cluster, day, hour and second: rows (CELL, STEP, MEASURES).

    ``orders`` takes the place of the inputs' orders. Lines need the day of their order.
    ``weights`` are those of ``spend.offer_weights`` if not given.
    """
    if weights is None:
        weights = spend.offer_weights(inputs.offer_events, inputs.templates, params)
    steps = _step_sums(order_rows(orders, inputs, params), inputs, weights, params)
    key, order = ", ".join(facts.KEY), ", ".join(STEP)
    so_far = f"OVER (PARTITION BY {key} ORDER BY {order})"
    wide = {name: f"cast(coalesce({name}, 0) AS decimal(38,0))" for name in (*facts.AMOUNTS, "special_sum", "spend_units")}
    counts = ("copies", "banners", *(f"{name}_bad" for name in facts.AMOUNTS))
    running = steps.selectExpr(
        *facts.KEY,
        *STEP,
        "copies AS n_rows",
        *aliased({name: f"sum({value}) {so_far}" for name, value in wide.items()}),
        *aliased({f"{name}_all" if name == "copies" else name: f"sum({name}) {so_far}" for name in counts}),
    )
    matched = "(order_id IS NOT NULL AND hr IS NOT NULL)"
    # Each row of an order meets every row's special spend, and each of those meetings the
    # spend of all rows.
    given = {
        "n_orders": "if(order_id IS NOT NULL, 1L, 0L)",
        "n_banner": "if(order_id IS NOT NULL AND banners > 0, 1L, 0L)",
        "special_sum": f"if({matched}, special_sum * copies_all, 0)",
        "targeted_sum": f"if({matched}, spend_units * copies_all * copies_all, 0)",
    }
    given |= {name: f"if({name}_bad > 0, 0, {name} * if({matched}, copies_all, 1))" for name in facts.AMOUNTS}
    given |= {f"{name}_bad": f"if({name}_bad > 0, 1L, 0L)" for name in facts.AMOUNTS}
    given = {
        name: f"cast({value} AS {'decimal(38,0)' if name in MONEY else 'bigint'})" for name, value in given.items()
    }
    total = running.selectExpr(*facts.KEY, *STEP, "n_rows", *aliased(given))
    before = f"OVER (PARTITION BY {key} ORDER BY {order})"
    added = {name: f"{name} - coalesce(lag({name}) {before}, 0)" for name in given}
    return summed(total.selectExpr(*CELL, *STEP, "n_rows", *aliased(added)))


def summed(rows: DataFrame) -> DataFrame:
    """Partials added up, with those left out that cancel."""
    sums = {name: f"cast(sum({name}) AS {'decimal(38,0)' if name in MONEY else 'bigint'})" for name in MEASURES}
    kept = " OR ".join(f"{name} <> 0" for name in MEASURES)
    return rows.groupBy(*CELL, *STEP).agg(*map(F.expr, aliased(sums))).where(kept)


def negated(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(*CELL, *STEP, *aliased({name: f"-{name}" for name in MEASURES}))


def _also(rows: DataFrame, labels: list[str]) -> DataFrame:
    """The rows once under each of the labels that are not NULL, expressions of their cluster."""
    return rows.selectExpr(f"explode(array_compact(array({', '.join(labels)}))) AS cluster", *CELL[1:], *STEP, *MEASURES)


def spread_orders(orders: DataFrame, cluster_dim: DataFrame, params: ReportParams) -> DataFrame:
    """(touched) ids of orders with rows in several of the clusters, NULL if rows without an id are such."""
    placed = filters.in_clusters(orders.where("excluded_flag = 0").select("order_id", "city_code"), cluster_dim, params)
    clusters = placed.groupBy("order_id").agg(F.expr("min(cluster) < max(cluster)").alias("spread"))
    return clusters.where("spread").select(F.col("order_id").alias("touched"))


def rolled_up(
    orders: DataFrame, inputs: ReportInputs, params: ReportParams, parents: dict[str, tuple[str, ...]]
) -> DataFrame:
    """Partials of all clusters of ``params``, those of ``parents`` added up from the clusters they consist of.

    Every row is carried once, in its own cluster, through the reduction of the orders; each
    cluster still has a cutoff of its own, at which its sums are looked up. The few orders
    that have rows in several clusters of a parent do not add up: they are taken out of the
    parent's sums and put in as its rows give them.
    """
    leaves = replace(params, clusters=tuple(c for c in params.clusters if c not in parents))
    own = partials(orders, inputs, leaves)
    spread = spread_orders(orders, inputs.cluster_dim, leaves)
    split = orders.join(spread, F.expr("order_id <=> touched"), "left_semi")
    above = tuple(parent for parent in parents if parent in params.clusters)
    labels = [f"if(cluster IN ({', '.join(map(repr, parents[p]))}), '{p}', NULL)" for p in above]
    parts = [_also(own, ["cluster", *labels])]
    if above:
        parts.append(_also(negated(partials(split, inputs, leaves)), labels))
        parts.append(partials(split, inputs, replace(params, clusters=above)))
    return summed(reduce(DataFrame.unionByName, parts))


# Running sums by the second at which rows are known, and by the second that a cutoff meets.
KNOWN, REACHED = "known", "reached"


def running_sums(sums: DataFrame) -> DataFrame:
    """Prefix sums: rows (side, CELL, position, latest, MEASURES) from added up partials.

    ``latest`` is the last second of a row known by then. A cell has one row per second.
    """
    sides = sums.selectExpr(
        "*",
        f"explode(array(struct('{KNOWN}' AS side, known AS position), struct('{REACHED}' AS side, second AS position))) AS at",
    ).selectExpr("at.side", "at.position", *CELL, "second", *MEASURES)
    totals = {name: f"sum({name})" for name in MEASURES}
    totals["latest"] = f"max(second) FILTER (WHERE n_rows > 0 AND second < {NEVER})"
    by_position = sides.groupBy("side", *CELL, "position").agg(*map(F.expr, aliased(totals)))
    window = f"OVER (PARTITION BY side, {', '.join(CELL)} ORDER BY position)"
    running = {
        name: f"cast(sum({name}) {window} AS {'decimal(38,0)' if name in MONEY else 'bigint'})" for name in MEASURES
    }
    return by_position.selectExpr(
        "side", *CELL, "position", f"max(latest) {window} AS latest", *aliased(running)
    )


def _looked_up(rows: DataFrame) -> DataFrame:
    """The last running sums of each cluster and hour."""
    held = f"max_by(struct({', '.join(('latest', *MEASURES))}), position) AS held"
    return rows.groupBy("cluster", "hr").agg(F.expr(held)).select("cluster", "hr", "held.*").where("n_rows > 0")


def clock_second(params: ReportParams) -> int:
    if params.as_of.microsecond:
        raise ValueError(f"the clock {params.as_of} is no whole second")
    return params.as_of.hour * 3600 + params.as_of.minute * 60 + params.as_of.second


def at_clock(running: DataFrame, params: ReportParams) -> tuple[DataFrame, DataFrame]:
    """Sums of today at the clock and of last week at the same time of day, by cluster and hour."""
    clusters = F.col("cluster").isin(list(params.clusters))
    rows = running.where(clusters & F.col("dt").isin(params.today, params.last_week))
    today = _looked_up(
        rows.where(f"side = '{KNOWN}' AND dt = DATE '{params.today}' AND position <= {clock_second(params)}")
    )
    # One row per cluster.
    cutoff = today.groupBy("cluster").agg(F.max("latest").alias("last_second"))
    before = rows.where(f"side = '{REACHED}' AND dt = DATE '{params.last_week}'").join(F.broadcast(cutoff), "cluster")
    return today, _looked_up(before.where("position <= last_second"))


def sums_at(sums: DataFrame, params: ReportParams) -> tuple[DataFrame, DataFrame]:
    """``at_clock`` for one clock, from partials that need not be added up and without running sums."""
    totals = aliased({name: f"cast(sum({name}) AS {'decimal(38,0)' if name in MONEY else 'bigint'})" for name in MEASURES})
    sums = sums.where(F.col("cluster").isin(list(params.clusters)))
    known = sums.where(f"dt = DATE '{params.today}' AND known <= {clock_second(params)}")
    # A second has rows if those that came are more than those that went.
    steps = known.groupBy("cluster", "hr", "second").agg(*map(F.expr, totals))
    latest = f"max(second) FILTER (WHERE n_rows > 0 AND second < {NEVER}) AS latest"
    today = steps.groupBy("cluster", "hr").agg(F.expr(latest), *map(F.expr, totals)).where("n_rows > 0")
    seconds = known.groupBy("cluster", "second").agg(F.sum("n_rows").alias("n_rows"))
    # One row per cluster.
    cutoff = seconds.where(f"n_rows > 0 AND second < {NEVER}").groupBy("cluster").agg(F.max("second").alias("last_second"))
    before = sums.where(f"dt = DATE '{params.last_week}'").join(F.broadcast(cutoff), "cluster")
    reached = before.where("second <= last_second").groupBy("cluster", "hr").agg(*map(F.expr, totals))
    return today, reached.where("n_rows > 0")


def _totals(side: str) -> dict[str, str]:
    totals = {}
    for name in MONEY:
        total = as_money(f"{side}.{name}")
        totals[name] = f"if({side}.{name}_bad > 0, NULL, {total})" if name in facts.AMOUNTS else total
    return totals


def paired(today: DataFrame, last_week: DataFrame) -> DataFrame:
    """The averages of both days side by side, one row per hour that has rows today."""
    both = today.alias("tw").join(
        last_week.alias("lw"), F.expr("tw.cluster = lw.cluster AND tw.hr <=> lw.hr"), "left"
    )
    columns = {}
    for side in ("tw", "lw"):
        rates = facts.rates(f"{side}.n_orders", f"{side}.n_banner", _totals(side))
        columns |= {f"{side}_{name}": rate for name, rate in rates.items()}
    return both.selectExpr("tw.cluster AS cluster", "tw.hr AS hr", *aliased(columns))


def hourly_report(running: DataFrame, inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The complete hourly report at the clock; of ``inputs`` only traffic and dimensions are read."""
    return report_at(at_clock(running, params), inputs, params)


def report_at(sums: tuple[DataFrame, DataFrame], inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The complete hourly report from the sums of today and of last week."""
    today, last_week = sums
    rates = compare.with_traffic(paired(today, last_week), inputs, params)
    return compare.with_total(rates, filters.cluster_cities(inputs.cluster_dim, params))
