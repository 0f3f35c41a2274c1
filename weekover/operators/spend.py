"""Discount spend of an order: offers started from listed templates, and special coupons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.numeric import as_money, is_amount, units
from weekover.operators import filters
from weekover.operators.joins import lookup
from weekover.params import ReportParams

ORDER_KEY = ("order_id", "hr", "dt")


def offer_lists(lines: DataFrame) -> DataFrame:
    """One ``offer_details`` list per order, as order rows store it, in order of its entries.

    A list holds the lines of one order; ``lines`` are those of the compared orders.
    """
    return lines.groupBy("order_id").agg(
        F.expr("sort_array(collect_list(struct(offer_id, discount))) AS offer_details")
    )


def compared_lines(lines: DataFrame, orders: DataFrame, params: ReportParams) -> DataFrame:
    """Offer lines (order_id, dt, offer_id, discount) of the compared days.

    Lines stored by day are pruned to the two days. Lines without a day are reduced to those
    of the compared orders before anything else shuffles them.
    """
    if "dt" in lines.columns:
        return lines.where(F.col("dt").isin(params.today, params.last_week))
    placed = filters.comparable_days(orders, params).select("order_id", "dt").distinct()
    return lines.join(placed, "order_id")


def explode_offers(rows: DataFrame, keys: Sequence[str] = ORDER_KEY, outer: bool = False) -> DataFrame:
    """One row per applied offer; orders with a NULL or empty list drop out unless ``outer``."""
    unfold = F.explode_outer if outer else F.explode
    return rows.select(*keys, unfold("offer_details").alias("offer")).select(
        *keys, "offer.offer_id", "offer.discount"
    )


def listed_events(
    offer_events: DataFrame, templates: DataFrame, params: ReportParams, others: Sequence[str] = ()
) -> DataFrame:
    """(offer, template) events of the listed templates within the look-back, none after today."""
    return (
        offer_events.where(F.col("dt").between(F.lit(params.lookback_start), F.lit(params.today)))
        .join(templates, "template_id", "left_semi")
        .select("offer_id", "template_id", *others)
    )


def targeted_offers(offer_events: DataFrame, templates: DataFrame, params: ReportParams) -> DataFrame:
    """Distinct (offer, template) pairs."""
    return listed_events(offer_events, templates, params).distinct()


def offer_weights(offer_events: DataFrame, templates: DataFrame, params: ReportParams) -> DataFrame:
    """How many listed templates each targeted offer runs under.

    The set of an offer is no longer than the template list, and one shuffle serves both
    the distinct pairs and their count.
    """
    return (
        listed_events(offer_events, templates, params)
        .groupBy("offer_id")
        .agg(F.expr("size(collect_set(template_id)) AS templates"))
    )


def stored_weights(weights: DataFrame, path: str) -> DataFrame:
    """The weights as a written table, for line tables of many times its size.

    Spark builds a runtime filter from a filtered scan, not from an aggregate. The filter is
    true for all rows; with it Spark can prune the lines by the offers before it shuffles
    them (``spark.sql.optimizer.runtime.bloomFilter``, by the sizes set there).
    """
    weights.write.parquet(path)
    return weights.sparkSession.read.schema(weights.schema).parquet(path).where("templates > 0")


def weighted_lines(lines: DataFrame, weights: DataFrame) -> DataFrame:
    """Lines of targeted offers with their spend in units.

    A discount that is no amount counts as none. An offer under several listed templates
    counts once per template. With the templates counted beforehand the join is many to one,
    so a popular offer cannot multiply rows.
    """
    keys = [c for c in lines.columns if c not in ("offer_id", "discount")]
    spent = f"coalesce({units('discount')}, 0L) * templates AS line_units"
    return lookup(lines, weights, ["offer_id"]).selectExpr(*keys, spent)


def order_spend(lines: DataFrame, weights: DataFrame) -> DataFrame:
    """Targeted spend of one copy of each order and day in units, from ``compared_lines``."""
    return (
        weighted_lines(lines.select("order_id", "dt", "offer_id", "discount"), weights)
        .groupBy("order_id", "dt")
        .agg(F.expr("sum(line_units) AS spend_units"))
    )


def unfolded(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows once per applied offer, and once without any, with the line's spend in units.

    ``first_line`` marks one line of each row, so that amounts can be summed beside spend.
    """
    lines = rows.selectExpr("* EXCEPT (offer_details)", "posexplode_outer(offer_details) AS (place, offer)")
    lines = lines.selectExpr(
        "* EXCEPT (place, offer)",
        "coalesce(place, 0) = 0 AS first_line",
        "offer.offer_id AS offer_id",
        f"coalesce({units('offer.discount')}, 0L) AS discount_units",
    )
    return lookup(lines, weights, ["offer_id"], "left").selectExpr(
        "* EXCEPT (offer_id, discount_units, templates)", "discount_units * coalesce(templates, 0) AS line_units"
    )


def nested_spend(rows: DataFrame, weights: DataFrame, keys: Sequence[str] = ORDER_KEY) -> DataFrame:
    """Targeted spend per key in units, from the offer arrays of the rows, every copy counted.

    Rows without offers fall to the join. Unfolding them keeps Spark from filtering the
    rows beforehand, so a shuffle below them is shared with the other uses of ``rows``.
    """
    return (
        weighted_lines(explode_offers(rows, keys, outer=True), weights)
        .groupBy(*keys)
        .agg(F.expr("sum(line_units) AS spend_units"))
    )


def targeted_spend(
    rows: DataFrame, lines: DataFrame, weights: DataFrame, keys: Sequence[str] = ORDER_KEY
) -> DataFrame:
    """Targeted spend per key from ``compared_lines``, every copy of an order counted.

    Copies are counted before the join, which then meets each order once per hour
    instead of once per copy and line.
    """
    copies = rows.groupBy(*keys).agg(F.expr("count(*) AS copies"))
    return copies.join(order_spend(lines, weights), ["order_id", "dt"]).selectExpr(
        *keys, f"{as_money('spend_units * copies')} AS targeted_spend"
    )


_FIRST_TOTAL = "try_cast(get(offer_totals, 0).total_offer_discount AS double)"

# Amount of the first offer total; NULL for a missing, empty or malformed entry, and for
# text that parses as a number but is no amount.
FIRST_OFFER_TOTAL = f"(CASE WHEN {is_amount(_FIRST_TOTAL)} THEN {_FIRST_TOTAL} END)"


def special_spend(rows: DataFrame, special_coupons: DataFrame) -> DataFrame:
    """Rows with ``special_spend``: the first offer total if the coupon is a special one."""
    listed = special_coupons.selectExpr("coupon_code", "TRUE AS is_special")
    return rows.join(listed, "coupon_code", "left").selectExpr(
        "* EXCEPT (is_special)", f"CASE WHEN is_special THEN {FIRST_OFFER_TOTAL} END AS special_spend"
    )
