"""Schemas of the canonical input tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY_COLUMNS = (
    "order_bill",
    "cart_discount",
    "platform_discount",
    "platform_discount_hit",
    "merchant_discount_hit",
    "merchant_offers_discount",
    "alliance_discount",
    "total_platform_discount",
)

OFFER = T.StructType(
    [T.StructField("offer_id", T.LongType()), T.StructField("discount", T.DoubleType())]
)
OFFER_TOTAL = T.StructType([T.StructField("total_offer_discount", T.StringType())])

ORDER_FACTS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("created_on", T.TimestampNTZType()),
        T.StructField("dt", T.DateType()),
        T.StructField("city_code", T.IntegerType()),
        T.StructField("excluded_flag", T.IntegerType()),
        T.StructField("coupon_code", T.StringType()),
        T.StructField("banner_factor", T.DoubleType()),
        *[T.StructField(name, T.DoubleType()) for name in MONEY_COLUMNS],
        T.StructField("offer_details", T.ArrayType(OFFER)),
        T.StructField("offer_totals", T.ArrayType(OFFER_TOTAL)),
    ]
)

OFFER_LINES = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("dt", T.DateType()),
        T.StructField("offer_id", T.LongType()),
        T.StructField("discount", T.DoubleType()),
    ]
)

OFFER_EVENTS = T.StructType(
    [
        T.StructField("offer_id", T.LongType()),
        T.StructField("template_id", T.StringType()),
        T.StructField("dt", T.DateType()),
    ]
)

TEMPLATES = T.StructType([T.StructField("template_id", T.StringType())])
SPECIAL_COUPONS = T.StructType([T.StructField("coupon_code", T.StringType())])

CITY_DIM = T.StructType(
    [
        T.StructField("city_id", T.IntegerType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)

CLUSTER_DIM = T.StructType(
    [T.StructField("city_code", T.IntegerType()), T.StructField("cluster", T.StringType())]
)

CLUSTER_CLASSES = T.StructType(
    [T.StructField("cluster", T.StringType()), T.StructField("classification", T.StringType())]
)

TRAFFIC_BUCKETS = T.StructType(
    [
        T.StructField("dt", T.DateType()),
        T.StructField("hr", T.TimestampNTZType()),
        T.StructField("city", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("classification", T.StringType()),
        T.StructField("sessions", T.LongType()),
        T.StructField("lw_sessions", T.LongType()),
        T.StructField("conv_sessions", T.LongType()),
        T.StructField("lw_conv_sessions", T.LongType()),
    ]
)
