"""Canonical parquet tables: order facts and offer events are partitioned by ``dt``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weekover.sources import schemas
from weekover.sources.inputs import FrameInputs


def write_by_day(df: DataFrame, path: str) -> None:
    """Store a daily table so that a report prunes to the two days it compares.

    The rebalance hint lets AQE split a day that holds more rows than the others.
    """
    (
        df.hint("rebalance", "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(path)
    )


# Setting of sessions that join bucketed tables: orders meet their lines by id and day, and
# being stored by id is enough. It lets other joins use such partitionings too, which AQE
# cannot split, so it does not belong into sessions without such tables.
BUCKETED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Store a daily table by day, and inside a day in ``buckets`` sorted by order id.

    Tables of the same number of buckets join on the order id, and group by it, as they are
    stored. All rows of an order are read by one task, so an order that holds a large part of
    a day takes as long as that part does; where that can be, ``write_by_day`` is the form
    whose shuffles are split. ``name`` is the table's name in the session's catalog.
    """
    (
        df.repartition(buckets, "order_id")
        .write.mode("overwrite")
        .partitionBy("dt")
        .bucketBy(buckets, "order_id")
        .sortBy("order_id")
        .option("path", path)
        .saveAsTable(name)
    )
    return df.sparkSession.table(name)


def read_inputs(spark: SparkSession, root: str) -> FrameInputs:
    """Read the canonical tables below ``root`` with nested offers.

    For offers stored as lines by day, replace ``offer_lines`` by a read of that table and
    drop ``offer_details`` from the orders.
    """

    def table(name, schema):
        return spark.read.schema(schema).parquet(f"{root}/{name}")

    return FrameInputs(
        orders=table("order_facts", schemas.ORDER_FACTS),
        offer_lines=None,
        offer_events=table("offer_events", schemas.OFFER_EVENTS),
        templates=table("templates", schemas.TEMPLATES),
        special_coupons=table("special_coupons", schemas.SPECIAL_COUPONS).distinct(),
        city_dim=table("city_dim", schemas.CITY_DIM),
        cluster_dim=table("cluster_dim", schemas.CLUSTER_DIM).distinct(),
        cluster_classes=table("cluster_classes", schemas.CLUSTER_CLASSES).distinct(),
        traffic=table("traffic_buckets", schemas.TRAFFIC_BUCKETS),
    )
