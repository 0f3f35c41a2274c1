"""App sessions and conversions of today's traffic buckets, each with last week's twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekover.metrics import TRAFFIC_MEASURES
from weekover.params import ReportParams


def _totals(function: str) -> list[Column]:
    return [F.expr(f"{function}({m}) AS {m}") for m in TRAFFIC_MEASURES]


def cluster_traffic(traffic: DataFrame, cluster_classes: DataFrame, params: ReportParams) -> DataFrame:
    """Today's app buckets of the classes that make up each cluster.

    Buckets after the clock of the run keep last week's counts; today's are not known yet.
    """
    known = {m: f"if(hr <= {params.now}, {m}, 0L)" for m in ("sessions", "conv_sessions")}
    classes = cluster_classes.where(F.col("cluster").isin(list(params.clusters)))
    return (
        traffic.where((F.col("dt") == F.lit(params.today)) & F.col("platform").isin(list(params.platforms)))
        .withColumns({m: F.expr(count) for m, count in known.items()})
        .withColumn("hr", F.hour("hr"))
        .join(classes, "classification")
    )


def traffic_by_hour(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster", "hr").agg(*_totals("sum"))


def traffic_by_city(rows: DataFrame) -> DataFrame:
    """Sums by lower-cased city name."""
    return rows.groupBy("cluster", F.lower("city").alias("city_key"), "hr").agg(*_totals("sum"))


def traffic_by_state(rows: DataFrame, city_dim: DataFrame) -> DataFrame:
    """Sums by state; the city name finds its state regardless of case."""
    cities = city_dim.select(F.lower("city_name").alias("city_key"), "state")
    return (
        rows.withColumn("city_key", F.lower("city"))
        .join(cities, "city_key")
        .groupBy("cluster", "state", "hr")
        .agg(*_totals("sum"))
    )


def group_lookup(sums: DataFrame, name: str) -> DataFrame:
    """Traffic by lower-cased group name for joining to facts.

    ``spellings`` counts the spellings of a name that traffic was summed under: each of
    them meets the orders once, so it multiplies their sums, while traffic itself is the
    largest of the spellings.
    """
    return sums.groupBy("cluster", F.lower(name).alias("grp_key"), "hr").agg(
        F.expr("count(*) AS spellings"), *_totals("max")
    )
