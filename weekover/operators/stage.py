"""One reduction of the orders for the hourly, the city and the state report.

The three reports look at the same rows in two ways: the hourly one takes exact copies once,
wherever they are, the others take every copy in the city it is in. The stage carries both
counts: one row per cluster, order, hour, city and second of the day, with the amounts of all
copies and with those of the copies that are the first of their kind. It is written once;
the cutoff is read from it too, so the orders are read, joined and reduced a single time.

Seconds are kept because last week's cutoff is not known before today's rows are seen. They
bound the rows of an order in the stage, however many copies it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.labels import COUPON_PRESENT
from weekover.functions.numeric import aliased, sound_sum, units
from weekover.operators import compare, facts, filters, spend, traffic
from weekover.params import ReportParams
from weekover.sources.inputs import ReportInputs

# Columns of the stage for all copies and for first ones.
ALL, FIRST = "all", "first"
_TOTALS = (*facts.AMOUNTS, "special_sum", "spend_sum")


def _marked(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """Rows of the compared days, equal ones of a city and second counted, the first of equal ones marked."""
    known = filters.comparable_days(inputs.orders, params)
    rows = filters.in_clusters(known, inputs.cluster_dim, params)
    columns = facts.distinct_rows(rows).columns
    counted = (
        rows.withColumn("second", F.expr(filters.second_of_day("created_on")))
        .groupBy(*columns, "city_code", "second")
        .agg(F.count("*").alias("n"))
    )
    # A row without a time comes last; equal rows differ in city and second only, which bounds them.
    place = "struct(second IS NULL, second, city_code)"
    first = f"{place} <=> min({place}) OVER (PARTITION BY {', '.join(columns)}) AS is_first"
    return counted.selectExpr("*", first)


def order_stage(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The stage: (cluster, order_id, hr, dt, city_code, second) with both kinds of sums. To be written."""
    rows = spend.special_spend(_marked(inputs, params), inputs.special_coupons)
    weights = spend.offer_weights(inputs.offer_events, inputs.templates, params)
    nested = "offer_details" in rows.columns
    if nested:
        rows = spend.unfolded(rows, weights)
    line = "first_line" if nested else "TRUE"
    amounts = facts.AMOUNTS | {"special_sum": units("special_spend")}
    banner = f"banner_factor > {params.banner_threshold}D"
    columns = {}
    for kind, times, taken in ((ALL, "n", line), (FIRST, "1", f"{line} AND is_first")):
        for name, amount in amounts.items():
            total = f"coalesce(sum(({amount}) * {times}) FILTER (WHERE {taken}), 0L)"
            columns[f"{kind}_{name}"] = sound_sum(amount, taken, total)
        columns[f"{kind}_copies"] = f"coalesce(sum({times}) FILTER (WHERE {taken}), 0L)"
        columns[f"{kind}_banner"] = f"coalesce(max({banner}) FILTER (WHERE {taken}), FALSE)"
        if nested:
            spent = "TRUE" if kind == ALL else "is_first"
            columns[f"{kind}_spend_sum"] = f"coalesce(sum(line_units * {times}) FILTER (WHERE {spent}), 0L)"
    columns["has_coupon"] = f"coalesce(max({COUPON_PRESENT}), FALSE)"
    stage = rows.groupBy(*facts.KEY, "city_code", "second").agg(*map(F.expr, aliased(columns)))
    if nested:
        return stage
    spent = spend.order_spend(spend.compared_lines(inputs.offer_lines, inputs.orders, params), weights)
    sums = {f"{kind}_spend_sum": f"coalesce(spend_units, 0L) * {kind}_copies" for kind in (ALL, FIRST)}
    return stage.join(spent, ["order_id", "dt"], "left").selectExpr("* EXCEPT (spend_units)", *aliased(sums))


def cut_off(stage: DataFrame, params: ReportParams) -> DataFrame:
    """The rows of the stage that are compared: all of today, and last week up to the cutoff of the cluster."""
    latest = stage.where(F.col("dt") == F.lit(params.today)).groupBy("cluster").agg(F.max("second").alias("last_second"))
    # One row per cluster.
    return stage.join(F.broadcast(latest), "cluster").where(f"dt = DATE '{params.today}' OR second <= last_second")


def _per_order(rows: DataFrame, kind: str, group: list[str]) -> DataFrame:
    """Rows as ``facts.order_level`` gives them: one per cluster, order, hour and group."""
    totals = {name: sound_sum(f"{kind}_{name}") for name in _TOTALS}
    totals |= {"copies": f"sum({kind}_copies)", "has_banner": f"max({kind}_banner)", "has_coupon": "max(has_coupon)"}
    found = rows.where(f"{kind}_copies > 0").groupBy(*facts.KEY, *group).agg(*map(F.expr, aliased(totals)))
    over_key = f"OVER (PARTITION BY {', '.join(facts.KEY)})"
    matched = "(order_id IS NOT NULL AND hr IS NOT NULL)"
    whole = {name: f"sum({name}) {over_key}" if group else name for name in ("copies", "special_sum", "spend_sum")}
    columns = {
        "copies": "copies",
        "has_banner": "has_banner AND order_id IS NOT NULL",
        "has_coupon": "has_coupon AND order_id IS NOT NULL",
        "special_sum": f"if({matched}, {whole['special_sum']}, 0)",
        "targeted_sum": f"if({matched}, {whole['spend_sum']}, 0)",
        "times": f"if({matched}, {whole['copies']}, 1)",
        "special_times": "copies",
        # The spend is of all copies already.
        "spend_copies": "1L",
    }
    return found.selectExpr(*facts.KEY, *group, *facts.AMOUNTS, *aliased(columns))


@dataclass(frozen=True)
class Reports:
    """The three reports over one written stage."""

    stage: DataFrame
    inputs: ReportInputs
    params: ReportParams

    def hourly_orders(self) -> DataFrame:
        return _per_order(cut_off(self.stage, self.params), FIRST, [])

    def hourly(self) -> DataFrame:
        kpis = facts.paired_kpis(self.hourly_orders(), self.params)
        rates = compare.with_traffic(kpis, self.inputs, self.params)
        return compare.with_total(rates, filters.cluster_cities(self.inputs.cluster_dim, self.params))

    def _grouped(self, name: str) -> DataFrame:
        groups = self.inputs.city_dim.select(F.col("city_id").alias("city_code"), F.col(name).alias("grp"))
        return _per_order(cut_off(self.stage, self.params).join(groups, "city_code"), ALL, ["grp"])

    def city(self) -> DataFrame:
        rows = traffic.cluster_traffic(self.inputs.traffic, self.inputs.cluster_classes, self.params)
        lookup = traffic.group_lookup(traffic.traffic_by_city(rows), "city_key")
        return facts.group_facts(self._grouped("city_name"), lookup, self.params)

    def state(self) -> DataFrame:
        rows = traffic.cluster_traffic(self.inputs.traffic, self.inputs.cluster_classes, self.params)
        lookup = traffic.group_lookup(traffic.traffic_by_state(rows, self.inputs.city_dim), "state")
        return facts.group_facts(self._grouped("state"), lookup, self.params)


def reports(inputs: ReportInputs, params: ReportParams, path: str) -> Reports:
    """Writes the stage to ``path`` and gives the reports over it."""
    stage = order_stage(inputs, params)
    stage.write.parquet(path)
    return Reports(stage.sparkSession.read.schema(stage.schema).parquet(path), inputs, params)
