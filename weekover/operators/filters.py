"""Row selection: compared days, clusters, same-time-of-day cutoff, user filters.

Joins carry no broadcast hint unless a comment states the bound of the hinted side;
everything else is left to Spark's own size check, with sort-merge joins and AQE skew
splitting beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.params import ReportParams


def comparable_days(orders: DataFrame, params: ReportParams) -> DataFrame:
    """Order rows of today and the same weekday last week without the excluded brand.

    Rows later than the clock of the run are not known yet; rows without a time stay.
    """
    known = F.col("created_on").isNull() | (F.col("created_on") <= F.expr(params.now))
    return orders.where(
        F.col("dt").isin(params.today, params.last_week) & (F.col("excluded_flag") == 0) & known
    ).withColumn("hr", F.hour("created_on"))


def cluster_cities(cluster_dim: DataFrame, params: ReportParams) -> DataFrame:
    return cluster_dim.where(F.col("cluster").isin(list(params.clusters))).select("city_code", "cluster")


def in_clusters(rows: DataFrame, cluster_dim: DataFrame, params: ReportParams) -> DataFrame:
    """Rows of the cluster cities, one per cluster a city belongs to (two at most)."""
    return rows.join(cluster_cities(cluster_dim, params), "city_code")


def second_of_day(moment: str) -> str:
    """Whole seconds since midnight: orders times of day as their ``HH:mm:ss`` text does."""
    return f"(hour({moment}) * 3600 + minute({moment}) * 60 + second({moment}))"


def day_cutoff(rows: DataFrame, params: ReportParams) -> DataFrame:
    """Latest time of day seen today, per cluster."""
    return (
        rows.where(F.col("dt") == F.lit(params.today))
        .groupBy("cluster")
        .agg(F.max("created_on").alias("latest"))
        .selectExpr(
            "cluster",
            "date_format(latest, 'HH:mm:ss') AS max_hms",
            f"{second_of_day('latest')} AS last_second",
        )
    )


def same_time_cutoff(rows: DataFrame, params: ReportParams) -> DataFrame:
    """All of today, and last week up to the cutoff of the cluster, whole seconds inclusive.

    A cluster without rows today has no cutoff and keeps no row. The cutoff frame holds
    one row per entry of ``params.clusters``, hence the broadcast.
    """
    kept = f"dt = DATE '{params.today}' OR {second_of_day('created_on')} <= last_second"
    return rows.join(F.broadcast(day_cutoff(rows, params)), "cluster").where(kept).drop("last_second")


def comparable_orders(orders: DataFrame, cluster_dim: DataFrame, params: ReportParams) -> DataFrame:
    """The base rows of every report: compared days, clusters, cutoff."""
    rows = in_clusters(comparable_days(orders, params), cluster_dim, params)
    return same_time_cutoff(rows, params)


def pick(rows: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Multi-select filter: no selected value means all."""
    return rows.where(F.col(column).isin(list(values))) if values else rows
