"""Per-order aggregation and the hourly, city and state facts.

The reported sums come from joining the base rows to the special spend of the same order
and hour, which is kept per row: n copies of an order meet n special rows, so every sum
counts n times. Here rows are first reduced to one per order and hour, and the totals
count it as many times as it has copies. The result is the same, no pair of copies is ever
built, and a distinct count of orders becomes a plain count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.labels import COUPON_PRESENT
from weekover.functions.numeric import aliased, as_money, copied_sum, exact, percent, ratio, rounded, sound_sum, units
from weekover.metrics import MONEY_MEASURES, TRAFFIC_MEASURES
from weekover.operators import filters, spend, traffic
from weekover.params import ReportParams
from weekover.sources.inputs import ReportInputs
from weekover.sources.schemas import MONEY_COLUMNS

KEY = ("cluster", *spend.ORDER_KEY)

_PLATFORM_HIT = units("platform_discount_hit")
_MERCHANT_HIT = units("merchant_discount_hit")

# Amounts of a row, in units.
AMOUNTS = {
    "bill_sum": units("order_bill"),
    "cdpo_sum": f"{units('cart_discount')} + {_MERCHANT_HIT} + {_PLATFORM_HIT}",
    "sdpo_sum": f"{units('platform_discount')} + {_PLATFORM_HIT} + {units('alliance_discount')}",
    "rdpo_sum": f"{_MERCHANT_HIT} + {units('merchant_offers_discount')}",
    "platform_sum": units("total_platform_discount"),
    "campaign_sum": _PLATFORM_HIT,
}


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Base rows of the hourly report without exact copies.

    Neither the exact time nor the city takes part, so a row stored twice for two cities
    of a cluster counts once. All columns are hashed, so equal keys of one order with
    different amounts spread over the partitions.
    """
    nested = [c for c in ("offer_details",) if c in rows.columns]
    return rows.select(*KEY, "coupon_code", "offer_totals", "banner_factor", *MONEY_COLUMNS, *nested).distinct()


def order_level(
    rows: DataFrame, inputs: ReportInputs, params: ReportParams, group: Sequence[str] = (), fan_out: bool = True
) -> DataFrame:
    """One row per cluster, group, order and hour: amounts of its rows and copies to count.

    ``times`` is how often each row is met by the special rows of its order,
    ``special_times`` how often the special spend is met, and ``spend_copies`` how many
    copies the targeted spend still has to be taken. ``fan_out=False`` meets every row
    once, which is the same on unique keys.
    """
    weights = spend.offer_weights(inputs.offer_events, inputs.templates, params)
    nested = "offer_details" in rows.columns
    # Rows of these reports are not made distinct, so no shuffle of them is there to be
    # shared: offers are unfolded in the same pass, and amounts count on a row's first line.
    one_pass = nested and bool(group)
    first = "first_line" if one_pass else "TRUE"
    totals = {
        name: sound_sum(amount, first, f"sum({amount}) FILTER (WHERE {first})") for name, amount in AMOUNTS.items()
    }
    totals |= {
        "copies": f"count_if({first})",
        "has_banner": f"max(banner_factor > {params.banner_threshold}D)",
        "has_coupon": f"max({COUPON_PRESENT})",
        "special_sum": f"sum({units('special_spend')}) FILTER (WHERE {first})",
    }
    if one_pass:
        totals["spend_units"] = "sum(line_units)"
    keys = ["cluster", "order_key"] if nested else list(KEY)
    if nested:
        # As one struct the key is never NULL, so the join below adds no NULL filter to
        # its right side and both sides share the shuffle that made the rows distinct.
        rows = rows.selectExpr("*", f"struct({', '.join(spend.ORDER_KEY)}) AS order_key")
    rows = spend.special_spend(rows, inputs.special_coupons)
    if one_pass:
        rows = spend.unfolded(rows, weights)
    per_order = rows.groupBy(*keys, *group).agg(*map(F.expr, aliased(totals)))
    # Spend joins before the window: the partitioning of a shuffled join serves both.
    if one_pass:
        pass
    elif nested:
        per_order = per_order.join(spend.nested_spend(rows, weights, keys), keys, "left")
    else:
        lines = spend.compared_lines(inputs.offer_lines, inputs.orders, params)
        per_order = per_order.join(spend.order_spend(lines, weights), ["order_id", "dt"], "left")
    # An order can reach several groups; there are at most as many rows per key as there
    # are groups in the city dimension.
    over_key = f"OVER (PARTITION BY {', '.join(keys)})"
    per_order = per_order.selectExpr(
        "* EXCEPT (special_sum, spend_units)",
        f"sum(spend_units) {over_key} AS spend_units" if one_pass else "spend_units",
        *(["order_key.*"] if nested else []),
        f"sum(copies) {over_key} AS key_copies" if group else "copies AS key_copies",
        f"sum(special_sum) {over_key} AS special_sum" if group and fan_out else "special_sum",
    )

    # A key with a NULL part matches nothing, so its rows meet no spend and no copy.
    matched = "(order_id IS NOT NULL AND hr IS NOT NULL)"
    columns = {
        "has_banner": "has_banner AND order_id IS NOT NULL",
        "has_coupon": "has_coupon AND order_id IS NOT NULL",
        "special_sum": f"if({matched}, special_sum, 0)",
        "targeted_sum": f"if({matched}, coalesce(spend_units, 0), 0)",
        "times": f"if({matched}, key_copies, 1)" if fan_out else "1L",
        "special_times": "copies" if fan_out else "1L",
        "spend_copies": "1L" if nested else "key_copies",
    }
    return per_order.selectExpr(*KEY, *group, *AMOUNTS, "copies", *aliased(columns))


def _totals(day: str = "TRUE") -> dict[str, str]:
    """Money totals over the rows of a day, with every copy counted as often as it is met."""
    totals = {name: copied_sum(name, "times", day=day) for name in AMOUNTS}
    totals["special_sum"] = copied_sum("special_sum", "special_times", day=day)
    totals["targeted_sum"] = copied_sum("targeted_sum", "copies", "times", "spend_copies", day=day)
    return {name: as_money(total) for name, total in totals.items()}


def rates(orders: str, banners: str, totals: dict[str, str]) -> dict[str, str]:
    """Per-order averages from expressions for counts and money totals."""
    found = {
        "total_opd": orders,
        "ob_pct": rounded(percent(banners, orders), 1),
        "amv": rounded(ratio(totals["bill_sum"], orders), 0),
    }
    for name in ("cdpo", "sdpo", "rdpo", "targeted", "special"):
        found[f"{name}_po"] = rounded(ratio(totals[f"{name}_sum"], orders), 2)
    found["total_platform_po"] = rounded(ratio(totals["platform_sum"], orders), 2)
    return found


def _rates(day: str = "TRUE") -> dict[str, str]:
    """Per-order averages over the rows of a day."""
    return rates(f"count(order_id) FILTER (WHERE {day})", f"count_if(has_banner AND {day})", _totals(day))


def hourly_kpis(per_order: DataFrame) -> DataFrame:
    """Per-order averages by cluster, hour and day.

    A money column that holds no amount makes the averages it enters NULL in its cell only.
    """
    return per_order.groupBy("cluster", "hr", "dt").agg(*map(F.expr, aliased(_rates())))


def paired_kpis(per_order: DataFrame, params: ReportParams) -> DataFrame:
    """The averages of both days side by side, one row per hour that has rows today.

    ``lw_total_opd`` is NULL for an hour without rows last week.
    """
    today, last_week = f"dt = DATE '{params.today}'", f"dt = DATE '{params.last_week}'"
    columns = {f"tw_{name}": rate for name, rate in _rates(today).items()}
    columns |= {f"lw_{name}": rate for name, rate in _rates(last_week).items()}
    columns["lw_total_opd"] = f"if(count_if({last_week}) > 0, {columns['lw_total_opd']}, NULL)"
    columns["today_rows"] = f"count_if({today})"
    return per_order.groupBy("cluster", "hr").agg(*map(F.expr, aliased(columns))).where("today_rows > 0")


def hourly_orders(inputs: ReportInputs, params: ReportParams, fan_out: bool = True) -> DataFrame:
    """One row per cluster, order and hour of the hourly report."""
    rows = distinct_rows(filters.comparable_orders(inputs.orders, inputs.cluster_dim, params))
    return order_level(rows, inputs, params, fan_out=fan_out)


def hourly_report_kpis(inputs: ReportInputs, params: ReportParams, fan_out: bool = True) -> DataFrame:
    return hourly_kpis(hourly_orders(inputs, params, fan_out))


def grouped_orders(inputs: ReportInputs, params: ReportParams, name: str) -> DataFrame:
    """Base rows with their group: the city or the state of the order's city code.

    Unlike in the hourly report copies stay, and orders of unknown cities drop out.
    """
    rows = filters.comparable_orders(inputs.orders, inputs.cluster_dim, params)
    groups = inputs.city_dim.select(F.col("city_id").alias("city_code"), F.col(name).alias("grp"))
    return rows.join(groups, "city_code")


def group_facts(per_order: DataFrame, lookup: DataFrame, params: ReportParams) -> DataFrame:
    """Sums by cluster, group, hour and day; traffic reaches today's rows only."""
    counts = {"orders": "count(order_id)", "coupon_orders": "count_if(has_coupon)"}
    totals = _totals()
    money_sums = {name: totals[name] for name in MONEY_MEASURES}
    sums = per_order.groupBy("cluster", "grp", "hr", "dt").agg(*map(F.expr, aliased(counts | money_sums)))
    today = lookup.selectExpr("*", f"DATE '{params.today}' AS dt")
    return (
        sums.selectExpr("*", "lower(grp) AS grp_key")
        .join(today, ["cluster", "grp_key", "hr", "dt"], "left")
        .selectExpr(
            "cluster",
            "grp",
            "hr",
            "dt",
            "orders",
            "coupon_orders",
            *aliased({name: exact(f"{name} * coalesce(spellings, 1)") for name in MONEY_MEASURES}),
            *aliased({name: f"coalesce({name}, 0)" for name in TRAFFIC_MEASURES}),
        )
    )


def city_facts(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    rows = traffic.cluster_traffic(inputs.traffic, inputs.cluster_classes, params)
    lookup = traffic.group_lookup(traffic.traffic_by_city(rows), "city_key")
    per_order = order_level(grouped_orders(inputs, params, "city_name"), inputs, params, ["grp"])
    return group_facts(per_order, lookup, params)


def state_facts(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    rows = traffic.cluster_traffic(inputs.traffic, inputs.cluster_classes, params)
    lookup = traffic.group_lookup(traffic.traffic_by_state(rows, inputs.city_dim), "state")
    per_order = order_level(grouped_orders(inputs, params, "state"), inputs, params, ["grp"])
    return group_facts(per_order, lookup, params)
