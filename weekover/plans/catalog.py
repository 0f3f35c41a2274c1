"""Named queries: every operator applied to the retail tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.functions import labels, numeric
from weekover.functions.numeric import aliased
from weekover.metrics import GROUP_METRICS
from weekover.operators import compare, facts, filters, groups, layout, lookback, monitor, prefix, snapshot, spend, stage, traffic
from weekover.params import ReportParams
from weekover.session import shared_folder
from weekover.sources import retail, tables
from weekover.sources.inputs import ReportInputs
from weekover.sources.schemas import MONEY_COLUMNS
from weekover.streaming import delta, refresh

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Arguments of the queries that take one.
PICKED_GROUPS = ("AMERICA", "EUROPE")
PICKED_HOURS = (10, 11, 12)
SORT_COLUMN = "d_special"
TIERS = {"critical": 4, "warning": 2}
REFRESHED_CLUSTER = "Tier 2"
SLIDING_DAYS = (5, 4, 3, 2)
ORDER_BUCKETS = 8
STEP_TIMES = ((11, 0), (13, 0), (14, 45))


def _plain(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles."""
    casts = {
        f.name: F.col(f.name).cast("double")
        for f in df.schema.fields
        if isinstance(f.dataType, T.DecimalType)
    }
    return df.withColumns(casts) if casts else df


def query(build: Callable[[ReportInputs, ReportParams], DataFrame]) -> Callable:
    """Register a query over the canonical frames under the name of its function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        params = retail.default_params()
        return _plain(build(retail.RetailInputs(spark, sf_dir, params), params))

    REGISTRY[build.__name__] = run
    return build


def nested_query(build: Callable[[ReportInputs, ReportParams], DataFrame]) -> Callable:
    """Register a query over order rows that carry their offers as a list."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        params = retail.default_params()
        return _plain(build(retail.NestedRetailInputs(spark, sf_dir, params), params))

    REGISTRY[build.__name__] = run
    return build


def table_query(build: Query) -> Query:
    """Register a query that needs the session and folder themselves."""
    REGISTRY[build.__name__] = lambda spark, sf_dir: _plain(build(spark, sf_dir))
    return build


# Base rows


@query
def order_base(i: ReportInputs, p: ReportParams) -> DataFrame:
    return filters.comparable_days(i.orders, p).select("hr", "dt", "order_id", "city_code", *MONEY_COLUMNS)


@query
def cluster_members(i: ReportInputs, p: ReportParams) -> DataFrame:
    return filters.cluster_cities(i.cluster_dim, p).groupBy("cluster").agg(F.count("*").alias("cities"))


@query
def cluster_filter(i: ReportInputs, p: ReportParams) -> DataFrame:
    rows = filters.comparable_days(i.orders, p)
    return filters.in_clusters(rows, i.cluster_dim, p).select("cluster", "order_id", "city_code")


@table_query
def cluster_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request label per customer, in the spellings a client may send."""
    p = retail.default_params()
    label = """concat('Tier', CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '_' END,
        if(c_custkey % 5 = 4, 'Next', cast(c_custkey % 5 AS string))) AS label"""
    slug = labels.cluster_slug("label", p.clusters, p.default_cluster)
    requests = retail.table(spark, sf_dir, "customer").selectExpr("c_custkey AS request_id", label)
    return requests.selectExpr("*", f"{slug} AS cluster")


@query
def time_cutoff(i: ReportInputs, p: ReportParams) -> DataFrame:
    rows = filters.comparable_orders(i.orders, i.cluster_dim, p)
    return rows.select("cluster", "order_id", "dt", "hr", "max_hms")


@query
def dedup_base(i: ReportInputs, p: ReportParams) -> DataFrame:
    rows = facts.distinct_rows(filters.comparable_orders(i.orders, i.cluster_dim, p))
    return rows.withColumn("totals", F.size("offer_totals").cast("bigint")).drop("offer_totals")


# Spend


@nested_query
def explode_offers(i: ReportInputs, p: ReportParams) -> DataFrame:
    """Order rows with one list of offers each, unfolded."""
    return spend.explode_offers(filters.comparable_days(i.orders, p))


@query
def targeted_offers(i: ReportInputs, p: ReportParams) -> DataFrame:
    return spend.targeted_offers(i.offer_events, i.templates, p)


@table_query
def offers_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targeted offers of successive days, each from the table of the day before and its own events."""
    now = retail.default_params()
    events = retail.RetailInputs(spark, sf_dir, now).offer_events
    templates = retail.RetailInputs(spark, sf_dir, now).templates
    days = [replace(now, as_of=now.as_of - timedelta(days=back)) for back in SLIDING_DAYS]
    sliding = lookback.SlidingOffers(spark, shared_folder(spark, "sliding-offers"))
    first, *following = days
    sliding.start(events, templates, first)
    found = []
    for p in following:
        sliding.add_day(events, templates, p)
        found.append(sliding.targeted(p).withColumn("day", F.lit(p.today)))
    return reduce(DataFrame.unionByName, found)


@query
def targeted_spend(i: ReportInputs, p: ReportParams) -> DataFrame:
    weights = spend.offer_weights(i.offer_events, i.templates, p)
    lines = spend.compared_lines(i.offer_lines, i.orders, p)
    return spend.targeted_spend(filters.comparable_days(i.orders, p), lines, weights)


@query
def special_spend(i: ReportInputs, p: ReportParams) -> DataFrame:
    rows = spend.special_spend(filters.comparable_days(i.orders, p), i.special_coupons)
    return rows.select(*spend.ORDER_KEY, "special_spend")


# Hourly report


@query
def hourly_kpis(i: ReportInputs, p: ReportParams) -> DataFrame:
    return facts.hourly_report_kpis(i, p)


@nested_query
def hourly_kpis_nested(i: ReportInputs, p: ReportParams) -> DataFrame:
    return facts.hourly_report_kpis(i, p)


@query
def special_inline(i: ReportInputs, p: ReportParams) -> DataFrame:
    return facts.hourly_report_kpis(i, p, fan_out=False)


def _traffic(i: ReportInputs, p: ReportParams) -> DataFrame:
    return traffic.cluster_traffic(i.traffic, i.cluster_classes, p)


@query
def traffic_hourly(i: ReportInputs, p: ReportParams) -> DataFrame:
    return traffic.traffic_by_hour(_traffic(i, p))


@query
def traffic_city(i: ReportInputs, p: ReportParams) -> DataFrame:
    return traffic.traffic_by_city(_traffic(i, p))


@query
def traffic_state(i: ReportInputs, p: ReportParams) -> DataFrame:
    return traffic.traffic_by_state(_traffic(i, p), i.city_dim)


@query
def hourly_wow(i: ReportInputs, p: ReportParams) -> DataFrame:
    return compare.hourly_rows(i, p)


@query
def hourly_overall(i: ReportInputs, p: ReportParams) -> DataFrame:
    return compare.hourly_report(i, p).orderBy("cluster", "pos")


@query
def hourly_rollup(i: ReportInputs, p: ReportParams) -> DataFrame:
    """The hourly report with the union cluster rolled up from its members' sums."""
    sums = prefix.rolled_up(i.orders, i, p, retail.CLUSTER_PARENTS)
    return prefix.hourly_report(prefix.running_sums(sums), i, p)


@table_query
def hourly_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly report over orders and lines that are stored by day and in buckets of orders."""
    p = retail.default_params()
    inputs = retail.RetailInputs(spark, sf_dir, p)
    stored = {}
    for name, rows in (("orders", inputs.orders), ("offer_lines", inputs.offer_lines)):
        path = shared_folder(spark, name)
        stored[name] = tables.write_bucketed(rows, f"{name}_{uuid.uuid4().hex}", path, ORDER_BUCKETS)
    return compare.hourly_report(replace(refresh.with_lines(inputs, stored["offer_lines"]), orders=stored["orders"]), p)


@query
def report_meta(i: ReportInputs, p: ReportParams) -> DataFrame:
    return compare.report_meta(compare.hourly_report(i, p), p)


@query
def partial_hour(i: ReportInputs, p: ReportParams) -> DataFrame:
    return compare.mark_partial_hour(compare.hourly_rows(i, p))


@query
def daypart_rollup(i: ReportInputs, p: ReportParams) -> DataFrame:
    return compare.daypart_rollup(facts.hourly_report_kpis(i, p))


@query
def metric_hour_matrix(i: ReportInputs, p: ReportParams) -> DataFrame:
    return layout.metric_hour_matrix(compare.hourly_report(i, p))


@query
def kpi_list(i: ReportInputs, p: ReportParams) -> DataFrame:
    return layout.kpi_list(compare.hourly_report(i, p))


@query
def change_direction(i: ReportInputs, p: ReportParams) -> DataFrame:
    return layout.change_direction(compare.hourly_rows(i, p))


# City and state reports


@query
def city_base(i: ReportInputs, p: ReportParams) -> DataFrame:
    rows = facts.grouped_orders(i, p, "city_name")
    return rows.select("cluster", "order_id", "hr", "dt", F.col("grp").alias("city"))


@query
def city_hourly(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.placed(facts.city_facts(i, p)).withColumnRenamed("grp", "city")


@nested_query
def city_hourly_nested(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.placed(facts.city_facts(i, p)).withColumnRenamed("grp", "city")


@query
def state_hourly(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.placed(facts.state_facts(i, p)).withColumnRenamed("grp", "state")


def _staged(name: str, nested: bool) -> Query:
    """All three reports from one stage: hours with averages, cities and states with sums."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = retail.default_params()
        inputs = (retail.NestedRetailInputs if nested else retail.RetailInputs)(spark, sf_dir, p)
        found = stage.reports(inputs, p, shared_folder(spark, "order-stage"))
        hours = {"kind": "'hourly'", "grp": "cast(NULL AS string)", "hr": "nullif(pos, 999)", "dt": f"DATE '{p.today}'"}
        hours |= {"orders": "total_opd", "bills": "amv", "cdpo": "cdpo_po", "targeted": "targeted_po", "special": "special_po"}
        frames = [found.hourly().selectExpr("cluster", *aliased(hours))]
        for kind, rows in (("city", found.city()), ("state", found.state())):
            sums = {"kind": f"'{kind}'", "grp": "grp", "hr": "hr", "dt": "dt", "orders": "orders", "bills": "cast(NULL AS double)"}
            sums |= {"cdpo": "cdpo_sum", "targeted": "targeted_sum", "special": "special_sum"}
            sums |= {"coupon_orders": "coupon_orders", "sessions": "sessions"}
            frames.append(_plain(rows.selectExpr("cluster", *aliased(sums))))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    REGISTRY[name] = run
    return run


_staged("all_reports", nested=False)
_staged("all_reports_nested", nested=True)


def _city_sums(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.group_hour_sums(facts.city_facts(i, p))


def _state_sums(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.group_hour_sums(facts.state_facts(i, p))


def _city_grid(i: ReportInputs, p: ReportParams, *metrics: str) -> DataFrame:
    return groups.group_hour_grid(_city_sums(i, p), p, metrics or GROUP_METRICS)


@query
def group_hour_sums(i: ReportInputs, p: ReportParams) -> DataFrame:
    return _city_sums(i, p)


@query
def group_keys(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.group_keys(_city_sums(i, p))


@query
def group_ratios(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.group_ratios(_city_sums(i, p))


@query
def group_summary(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.group_summary(_city_sums(i, p), p)


@query
def state_summary(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.group_summary(_state_sums(i, p), p)


@query
def group_hour_grid(i: ReportInputs, p: ReportParams) -> DataFrame:
    return _city_grid(i, p)


@query
def state_hour_grid(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.group_hour_grid(_state_sums(i, p), p)


@query
def nested_hourly(i: ReportInputs, p: ReportParams) -> DataFrame:
    """The nested form, its array as text: hour and the two sides' orders and conversion."""
    sides = "concat_ws('/', h.hr, h.tw.orders, h.lw.orders, h.tw.cvr, h.lw.cvr)"
    return groups.nested_hourly(_city_grid(i, p)).selectExpr(
        "cluster",
        "grp",
        "size(hours) AS n_hours",
        f"array_join(transform(hours, h -> {sides}), ' ') AS hours_text",
    )


@query
def nested_unfolded(i: ReportInputs, p: ReportParams) -> DataFrame:
    """The nested form unfolded again, with the position of each hour in its array."""
    nested = groups.nested_hourly(_city_grid(i, p))
    cell = nested.select("cluster", "grp", F.posexplode("hours").alias("slot", "cell"))
    return cell.select(
        "cluster",
        "grp",
        "slot",
        F.col("cell.hr").alias("hr"),
        *[F.col(f"cell.{s}.{m}").alias(f"{s}_{m}") for s in ("tw", "lw") for m in GROUP_METRICS],
    )


@query
def group_rank(i: ReportInputs, p: ReportParams) -> DataFrame:
    return layout.group_rank(groups.group_summary(_city_sums(i, p), p))


@query
def filter_groups(i: ReportInputs, p: ReportParams) -> DataFrame:
    return filters.pick(groups.group_summary(_state_sums(i, p), p), "grp", PICKED_GROUPS)


@query
def hour_reagg(i: ReportInputs, p: ReportParams) -> DataFrame:
    return groups.hour_reagg(_city_grid(i, p, "orders", "sessions", "cvr"), PICKED_HOURS)


@query
def sort_nulls_last(i: ReportInputs, p: ReportParams) -> DataFrame:
    return layout.sort_nulls_last(groups.group_summary(_city_sums(i, p), p), SORT_COLUMN)


def _pivot(metric: str):
    return lambda i, p: layout.pivot_metric(_city_grid(i, p, metric), metric)


def _heat(metric: str):
    return lambda i, p: layout.heat_tag(_city_grid(i, p, metric), metric)


def _register(name: str, build: Callable[[ReportInputs, ReportParams], DataFrame]) -> None:
    build.__name__ = name
    query(build)


_register("pivot_metric", _pivot("orders"))
_register("pivot_metric_cvr", _pivot("cvr"))
_register("heat_tag", _heat("cdpo"))
_register("heat_tag_inverted", _heat("oc_pct"))


# Live views


@query
def share_of_total(i: ReportInputs, p: ReportParams) -> DataFrame:
    return monitor.share_of_total(facts.city_facts(i, p), p).withColumnRenamed("grp", "city")


@query
def status_tier(i: ReportInputs, p: ReportParams) -> DataFrame:
    return monitor.status_tiers(facts.city_facts(i, p), p, **TIERS).withColumnRenamed("grp", "city")


@query
def peak_hour(i: ReportInputs, p: ReportParams) -> DataFrame:
    return monitor.peak_hour(facts.city_facts(i, p), p).withColumnRenamed("grp", "city")


@query
def trailing_hours(i: ReportInputs, p: ReportParams) -> DataFrame:
    return monitor.trailing_hours(_city_grid(i, p, "orders")).withColumnRenamed("grp", "city")


@query
def delayed_count(i: ReportInputs, p: ReportParams) -> DataFrame:
    return monitor.delayed_count(filters.comparable_days(i.orders, p), p)


@query
def latest_n(i: ReportInputs, p: ReportParams) -> DataFrame:
    return monitor.latest_orders(filters.comparable_days(i.orders, p))


# Stored results


@table_query
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = retail.default_params()
    root = shared_folder(spark, "snapshot")
    report = compare.hourly_report(retail.RetailInputs(spark, sf_dir, p), p)
    snapshot.write_snapshot(report, root, refresh.KIND, p)
    return snapshot.read_snapshot(spark, root, refresh.KIND)


@table_query
def snapshot_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city and the state summaries stored side by side, each under its kind, published together."""
    p = retail.default_params()
    root = shared_folder(spark, "snapshot")
    inputs = retail.RetailInputs(spark, sf_dir, p)
    sums = {"city": _city_sums(inputs, p), "state": _state_sums(inputs, p)}
    snapshot.write_snapshots({kind: groups.group_summary(s, p) for kind, s in sums.items()}, root, p)
    stored = [
        snapshot.read_snapshot(spark, root, kind).withColumn("kind", F.lit(kind)) for kind in ("city", "state")
    ]
    return stored[0].unionByName(stored[1])


@table_query
def snapshot_one_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refreshes of all three kinds, the earlier clock coming last: one clock is read, the later one."""
    now = retail.default_params()
    root = shared_folder(spark, "snapshot")
    for p in (now, replace(now, as_of=now.as_of.replace(hour=11, minute=0))):
        inputs = retail.RetailInputs(spark, sf_dir, p)
        reports = {refresh.KIND: compare.hourly_report(inputs, p).selectExpr("cluster", "hr AS name", "total_opd AS orders")}
        for kind, sums in (("city", _city_sums(inputs, p)), ("state", _state_sums(inputs, p))):
            reports[kind] = groups.group_summary(sums, p).selectExpr("cluster", "grp AS name", "tw_orders AS orders")
        snapshot.write_snapshots(reports, root, p)
    stored = [snapshot.read_snapshot(spark, root, kind).withColumn("kind", F.lit(kind)) for kind in reports]
    return reduce(DataFrame.unionByName, stored)


@table_query
def snapshot_refresh_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report stored earlier in the day, then one cluster refreshed at the present clock."""
    p = retail.default_params()
    before = replace(p, as_of=p.as_of.replace(hour=11, minute=0))
    root = shared_folder(spark, "snapshot")
    stored = compare.hourly_report(retail.RetailInputs(spark, sf_dir, before), before)
    snapshot.write_snapshot(stored, root, refresh.KIND, before)

    def build(one: ReportParams) -> DataFrame:
        return compare.hourly_report(retail.RetailInputs(spark, sf_dir, one), one)

    snapshot.refresh(spark, root, refresh.KIND, p.for_cluster(REFRESHED_CLUSTER), build)
    return snapshot.read_snapshot(spark, root, refresh.KIND)


@table_query
def snapshot_one_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored report of one cluster, asked for by its label."""
    p = retail.default_params()
    root = shared_folder(spark, "snapshot")
    snapshot.write_snapshot(compare.hourly_report(retail.RetailInputs(spark, sf_dir, p), p), root, refresh.KIND, p)
    (cluster,) = p.for_cluster(REFRESHED_CLUSTER).clusters
    return snapshot.read_snapshot(spark, root, refresh.KIND, cluster)


@table_query
def snapshot_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored report of all clusters, of which one is replaced by an empty result."""
    p = retail.default_params()
    root = shared_folder(spark, "snapshot")
    report = compare.hourly_report(retail.RetailInputs(spark, sf_dir, p), p)
    snapshot.write_snapshot(report, root, refresh.KIND, p)
    snapshot.write_snapshot(report.limit(0), root, refresh.KIND, p.for_cluster(REFRESHED_CLUSTER))
    return snapshot.read_snapshot(spark, root, refresh.KIND)


def _streamed(spark: SparkSession, sf_dir: str, folder: str, pattern: str, work: str, root: str, p: ReportParams) -> None:
    events = refresh.file_stream(spark, folder, retail.TABLES["events"], pattern)
    inputs = retail.RetailInputs(spark, sf_dir, p)
    # Lines of any landed order may be needed, so they are reduced by the landed orders.
    inputs = refresh.with_lines(inputs, retail.all_lines(spark, sf_dir))
    refresh.run_refresh(retail.order_stream(events, spark, sf_dir), inputs, work, root, p)


@table_query
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = retail.default_params()
    root = shared_folder(spark, "snapshot")
    _streamed(spark, sf_dir, sf_dir, "events.parquet", shared_folder(spark, "refresh"), root, p)
    return snapshot.read_snapshot(spark, root, refresh.KIND).drop("as_of")


@table_query
def incremental_refresh_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arriving in three files while the clock moves on, over one checkpoint."""
    work, root, folder = (shared_folder(spark, n) for n in ("refresh", "snapshot", "events"))
    events = retail.table(spark, sf_dir, "events")
    for step, moment in enumerate(STEP_TIMES):
        events.where(F.col("event_id") % len(STEP_TIMES) == step).write.mode("append").parquet(folder)
        p = retail.default_params()
        p = replace(p, as_of=p.as_of.replace(hour=moment[0], minute=moment[1]))
        _streamed(spark, sf_dir, folder, "part-*.parquet", work, root, p)
    return snapshot.read_snapshot(spark, root, refresh.KIND).drop("as_of")


def _resent(i: ReportInputs) -> DataFrame:
    """Order rows with the step they come in: some again in the next step, changed bills in a step of their own."""
    own = f"CAST(pmod(xxhash64(order_id, order_bill), {len(STEP_TIMES)}) AS int)"
    again = f"if(order_id % 7 = 0, array({own}, ({own} + 1) % {len(STEP_TIMES)}), array({own}))"
    return i.orders.selectExpr("*", f"explode({again}) AS step")


@table_query
def incremental_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows arriving in three steps, late, changed and repeated ones among them, each step sent twice.

    The clock moves on, and the stored sums are compacted after the second step.
    """
    now = retail.default_params()
    root, orders = shared_folder(spark, "snapshot"), shared_folder(spark, "resent")
    clocks = [replace(now, as_of=now.as_of.replace(hour=h, minute=m)) for h, m in STEP_TIMES]
    everything = retail.RetailInputs(spark, sf_dir, now)
    _resent(everything).write.partitionBy("step").parquet(orders)
    schema = everything.orders.schema
    store = delta.DeltaStore(spark, shared_folder(spark, "delta"), schema)
    for step, p in enumerate(clocks):
        inputs = refresh.with_lines(retail.RetailInputs(spark, sf_dir, p), retail.all_lines(spark, sf_dir))
        batch = spark.read.schema(schema).parquet(f"{orders}/step={step}")
        for _ in range(2):
            store.apply(batch, step, inputs, p)
        snapshot.write_snapshot(store.report(inputs, p), root, refresh.KIND, p)
        if step == 1:
            store.compact(p)
    return snapshot.read_snapshot(spark, root, refresh.KIND).drop("as_of")


@table_query
def cutoff_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums of both days at three clocks, from running sums that are stored once."""
    now = retail.default_params()
    end = replace(now, as_of=now.as_of.replace(hour=23, minute=59, second=59))
    inputs = retail.RetailInputs(spark, sf_dir, end)
    path = shared_folder(spark, "running-sums")
    running = prefix.running_sums(prefix.partials(inputs.orders, inputs, end))
    running.write.partitionBy("side", "dt").parquet(path)
    running = spark.read.schema(running.schema).parquet(path)
    found = []
    for hour, minute in STEP_TIMES:
        p = replace(now, as_of=now.as_of.replace(hour=hour, minute=minute))
        for day, sums in zip((p.today, p.last_week), prefix.at_clock(running, p)):
            columns = {"as_of": f"'{p.as_of_text}'", "cluster": "cluster", "hr": "hr", "dt": f"DATE '{day}'"}
            columns |= {"orders": "n_orders", "banner_orders": "n_banner"}
            columns |= {name: numeric.as_money(name) for name in prefix.MONEY}
            found.append(sums.selectExpr(*aliased(columns)))
    return reduce(DataFrame.unionByName, found)


# Scalar functions


@query
def scalar_functions(i: ReportInputs, p: ReportParams) -> DataFrame:
    first_total = "get(offer_totals, 0).total_offer_discount"
    columns = {
        "hour_of": "hour(created_on)",
        "time_of_day": "date_format(created_on, 'HH:mm:ss')",
        "today": f"DATE '{p.today}'",
        "last_week": f"DATE '{p.today}' - {p.compare_days}",
        "lower_code": "lower(coupon_code)",
        "hit_or_zero": "coalesce(platform_discount_hit, 0)",
        "code_or_null": "nullif(coupon_code, '')",
        "bill_1dp": "cast(round(cast(order_bill AS decimal(18,2)), 1) AS double)",
        "hr_text": "cast(hour(created_on) AS string)",
        "hr_int": "cast(cast(hour(created_on) AS string) AS int)",
        "first_total": f"try_cast({first_total} AS double)",
        "has_coupon": labels.COUPON_PRESENT,
        "day_label": f"CASE WHEN dt = DATE '{p.today}' THEN 'today' ELSE 'last week' END",
        "is_listed": "coupon_code IN ('1-URGENT', '2-HIGH')",
        "quotient": "order_id / nullif(city_code, 0)",
        "date_prefix": "to_date(substring(cast(created_on AS string), 1, 10))",
        "distance": "abs(coalesce(platform_discount_hit, 0) - platform_discount)",
    }
    return i.orders.selectExpr("order_id", *aliased(columns))
