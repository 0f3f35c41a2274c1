"""Mapping of the retail tables (orders, lineitem, part, events, ...) onto the canonical frames.

An event is an order placed at ``ts``; the order and customer rows give its bill, coupon
and city, its lineitems are the offers applied to it, a nation is a city and a region a
state. Every frame is a lazy projection of the parquet tables.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.operators import spend
from weekover.params import ReportParams
from weekover.sources import schemas

# The clock of the test runs, and the lists that stand for dimension tables.
AS_OF = datetime(2024, 1, 30, 14, 45)
TEMPLATE_IDS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")
SPECIAL_COUPON_CODES = ("1-URGENT", "2-HIGH")
CLUSTER_CLASSES = (
    ("tier_1", "class_1"),
    ("tier_2", "class_2"),
    ("tier_3", "class_3"),
    ("tier_next", "class_2"),
    ("tier_next", "class_3"),
)

# Clusters that consist of others.
CLUSTER_PARENTS = {"tier_next": ("tier_2", "tier_3")}

# One order in COPY_EVERY is stored twice, and another one again with a changed bill, as
# an at-least-once feed would do.
COPY_EVERY = 50

# Declared schemas of the columns in use, so that no read starts a job to infer them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def default_params(**overrides) -> ReportParams:
    return ReportParams(**{"as_of": AS_OF, **overrides})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _time(moment: datetime | date) -> str:
    return f"cast('{moment}' as timestamp_ntz)"


def _on_day(ts: str, day: date) -> str:
    """``ts`` falls on ``day``, as a range that reaches the parquet scan."""
    return f"({ts} >= {_time(day)} AND {ts} < {_time(day + timedelta(days=1))})"


def compared_events(events: DataFrame, params: ReportParams) -> DataFrame:
    """Events of the two compared days, none later than the clock of the run."""
    days = f"{_on_day('ts', params.today)} OR {_on_day('ts', params.last_week)}"
    return events.where(f"({days}) AND ts <= {_time(params.as_of)}")


def order_facts(events: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Order rows; the resent ones are repeated in place, without a second scan."""
    placed = (
        events.join(orders, F.col("event_id") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .selectExpr(
            "*",
            "CASE WHEN event_type = 'click' THEN o_orderkey % 15 END AS hit",
            f"""explode(CASE o_orderkey % {COPY_EVERY}
                WHEN 0 THEN array(0, 0) WHEN 1 THEN array(0, 10) ELSE array(0) END) AS raise""",
        )
    )
    return placed.selectExpr(
        "event_id AS order_id",
        "ts AS created_on",
        "cast(ts AS date) AS dt",
        "c_nationkey AS city_code",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS excluded_flag",
        """CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN ''
           ELSE o_orderpriority END AS coupon_code""",
        "cast(10 + o_custkey % 10 AS double) / 10 AS banner_factor",
        "o_totalprice + raise AS order_bill",
        "value AS cart_discount",
        "cast(o_orderkey % 60 AS double) AS platform_discount",
        "cast(hit AS double) AS platform_discount_hit",
        "cast(o_orderkey % 40 AS double) AS merchant_discount_hit",
        "cast(o_custkey % 25 AS double) AS merchant_offers_discount",
        "CASE WHEN event_type = 'purchase' THEN 10D END AS alliance_discount",
        "cast(o_orderkey % 60 + coalesce(hit, 0) + 80 AS double) AS total_platform_discount",
        """CASE WHEN o_orderkey % 7 = 0 THEN cast(array() AS array<struct<total_offer_discount: string>>)
           ELSE array(named_struct('total_offer_discount', cast(o_orderkey % 80 AS string))) END AS offer_totals""",
    )


def offer_lines(lineitem: DataFrame, compared: DataFrame) -> DataFrame:
    """Lines of the orders placed by the compared events, with the day; all others are dropped first."""
    placed = compared.selectExpr("event_id AS l_orderkey", "cast(ts AS date) AS dt").distinct()
    return lineitem.join(placed, "l_orderkey").selectExpr(
        "l_orderkey AS order_id", "dt", "l_partkey AS offer_id", "l_quantity AS discount"
    )


def offer_events(part: DataFrame, params: ReportParams) -> DataFrame:
    """One event per part and brand; every twentieth part also runs under the first template."""
    return part.selectExpr(
        "p_partkey AS offer_id",
        f"explode(if(p_partkey % 20 = 0, array(p_brand, '{TEMPLATE_IDS[0]}'), array(p_brand))) AS template_id",
        f"date_sub(DATE '{params.today}', 3 * p_size) AS dt",
    )


def city_dim(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "n_nationkey AS city_id", "n_name AS city_name", "r_name AS state"
    )


TIER = "CASE WHEN n_nationkey < 5 THEN '1' WHEN n_nationkey < 15 THEN '2' ELSE '3' END"


def cluster_dim(nation: DataFrame) -> DataFrame:
    """One row per membership: cities of the second and third tier are also in ``tier_next``."""
    return nation.selectExpr(
        "n_nationkey AS city_code",
        f"explode(if(n_nationkey < 5, array('tier_1'), array('tier_' || {TIER}, 'tier_next'))) AS cluster",
    )


def traffic_buckets(events: DataFrame, nation: DataFrame, params: ReportParams) -> DataFrame:
    """Hourly sessions by city and platform, each with its counterpart a week earlier.

    Last week's events keep the whole day, as the upstream bucket table does.
    """
    today = f"({_on_day('ts', params.today)} AND ts <= {_time(params.as_of)})"
    last_week = _on_day("ts", params.last_week)
    moment = f"if(is_today, ts, ts + INTERVAL '{params.compare_days}' DAY)"

    def counted(condition: str, name: str) -> Column:
        return F.expr(f"count_if({condition}) AS {name}")

    return (
        events.where(f"{today} OR {last_week}")
        .selectExpr("*", f"{today} AS is_today")
        .join(nation, F.col("user_id") % 25 == F.col("n_nationkey"))
        .selectExpr(
            "is_today",
            "event_type = 'purchase' AS converted",
            f"cast(date_trunc('HOUR', {moment}) AS timestamp_ntz) AS hr",
            "if(user_id % 2 = 1, lower(n_name), n_name) AS city",
            "CASE user_id % 3 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' ELSE 'Web' END AS platform",
            f"'class_' || {TIER} AS classification",
        )
        .groupBy("hr", "city", "platform", "classification")
        .agg(
            counted("is_today", "sessions"),
            counted("NOT is_today", "lw_sessions"),
            counted("is_today AND converted", "conv_sessions"),
            counted("NOT is_today AND converted", "lw_conv_sessions"),
        )
        .selectExpr("*", "cast(hr AS date) AS dt")
    )


def inline(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """Literal rows as a local relation, whose exact size Spark's broadcast check can see."""
    columns = dict(zip(schema.names, map(list, zip(*rows))))
    return spark.createDataFrame(pa.table(columns), schema)


class RetailInputs:
    """The canonical frames over the tables in ``sf_dir``, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: ReportParams):
        self._spark, self._sf_dir, self._params = spark, sf_dir, params

    def _table(self, name: str) -> DataFrame:
        return table(self._spark, self._sf_dir, name)

    @cached_property
    def _compared(self) -> DataFrame:
        return compared_events(self._table("events"), self._params)

    @cached_property
    def orders(self) -> DataFrame:
        return order_facts(self._compared, self._table("orders"), self._table("customer"))

    @cached_property
    def offer_lines(self) -> DataFrame:
        return offer_lines(self._table("lineitem"), self._compared)

    @cached_property
    def offer_events(self) -> DataFrame:
        return offer_events(self._table("part"), self._params)

    @cached_property
    def templates(self) -> DataFrame:
        return inline(self._spark, [(t,) for t in TEMPLATE_IDS], schemas.TEMPLATES)

    @cached_property
    def special_coupons(self) -> DataFrame:
        return inline(self._spark, [(c,) for c in SPECIAL_COUPON_CODES], schemas.SPECIAL_COUPONS)

    @cached_property
    def city_dim(self) -> DataFrame:
        return city_dim(self._table("nation"), self._table("region"))

    @cached_property
    def cluster_dim(self) -> DataFrame:
        return cluster_dim(self._table("nation"))

    @cached_property
    def cluster_classes(self) -> DataFrame:
        return inline(self._spark, CLUSTER_CLASSES, schemas.CLUSTER_CLASSES)

    @cached_property
    def traffic(self) -> DataFrame:
        return traffic_buckets(self._table("events"), self._table("nation"), self._params)


class NestedRetailInputs(RetailInputs):
    """The same with offers in the other storage form: one list on each order row."""

    @cached_property
    def orders(self) -> DataFrame:
        flat = RetailInputs(self._spark, self._sf_dir, self._params)
        return flat.orders.join(spend.offer_lists(flat.offer_lines), "order_id", "left")

    offer_lines = None


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all orders, without a day."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.selectExpr("l_orderkey AS order_id", "l_partkey AS offer_id", "l_quantity AS discount")


def order_stream(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical order rows of a stream of events; the other two tables do not change."""
    return order_facts(events, table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))
