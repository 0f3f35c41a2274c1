"""Live-operations views over city facts and today's orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.labels import (
    CRITICAL_ORDERS,
    DELAYED_MINUTES,
    WARNING_ORDERS,
    delay_severity,
    status_tier,
)
from weekover.functions.numeric import percent, rounded
from weekover.params import ReportParams

# Length of a trailing series, and of the live order list.
TRAILING_HOURS = 7
QUEUE_LENGTH = 12


def _today(rows: DataFrame, params: ReportParams) -> DataFrame:
    return rows.where(F.col("dt") == F.lit(params.today))


def share_of_total(facts: DataFrame, params: ReportParams) -> DataFrame:
    """Today's orders of each group and their share of the cluster."""
    orders = _today(facts, params).groupBy("cluster", "grp").agg(F.expr("sum(orders) AS orders"))
    # A cluster has one row per group of the city dimension.
    whole = "sum(orders) OVER (PARTITION BY cluster)"
    return orders.selectExpr("cluster", "grp", "orders", f"{rounded(percent('orders', whole), 1)} AS share_pct")


def status_tiers(
    facts: DataFrame, params: ReportParams, critical: int = CRITICAL_ORDERS, warning: int = WARNING_ORDERS
) -> DataFrame:
    tier = status_tier("orders", critical, warning)
    return _today(facts, params).selectExpr("cluster", "grp", "hr", "orders", f"{tier} AS status")


def peak_hour(facts: DataFrame, params: ReportParams) -> DataFrame:
    """Hour with the most orders today; of equal hours the later one."""
    return (
        _today(facts, params)
        .groupBy("cluster", "grp")
        .agg(F.expr("max_by(hr, struct(orders, hr)) AS peak_hr"), F.expr("max(orders) AS peak_orders"))
    )


def trailing_hours(grid: DataFrame, hour: int | None = None) -> DataFrame:
    """Today's orders over the seven hours that end at each hour, or at the chosen one."""
    # A group has 24 rows at most.
    span = f"OVER (PARTITION BY cluster, grp ORDER BY hr RANGE BETWEEN {TRAILING_HOURS - 1} PRECEDING AND CURRENT ROW)"
    rows = grid.selectExpr(
        "cluster",
        "grp",
        "hr",
        "tw_orders AS orders",
        f"array_join(collect_list(cast(tw_orders AS string)) {span}, ',') AS series",
        f"{rounded(f'avg(tw_orders) {span}', 2)} AS avg_7",
    )
    return rows if hour is None else rows.where(F.col("hr") == hour)


def delayed_count(orders: DataFrame, params: ReportParams) -> DataFrame:
    """Today's orders by city that have been open for more than ten minutes, with severity."""
    as_of = F.lit(params.as_of_text).cast(orders.schema["created_on"].dataType)
    return (
        _today(orders, params)
        .withColumn("minutes", F.timestamp_diff("MINUTE", F.col("created_on"), as_of))
        .selectExpr("city_code", "minutes", f"{delay_severity('minutes')} AS severity")
        .groupBy("city_code")
        .agg(
            F.expr(f"count_if(minutes > {DELAYED_MINUTES}) AS delayed"),
            F.expr("count_if(severity = 'high') AS high"),
            F.expr("count_if(severity = 'medium') AS medium"),
        )
    )


def latest_orders(orders: DataFrame, n: int = QUEUE_LENGTH) -> DataFrame:
    """The n latest orders, newest first."""
    latest = orders.select("order_id", "created_on").orderBy(F.desc("created_on"), "order_id").limit(n)
    return latest.selectExpr("*", "row_number() OVER (ORDER BY created_on DESC, order_id) AS pos")
