"""Hand-checked cases where a plausible shortcut would give another result."""

from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from frames import LAST_WEEK, PARAMS, TODAY, bucket, inputs, one, order, rows

from weekover.functions.labels import direction
from weekover.functions.numeric import rounded
from weekover.operators import compare, facts, filters, groups, layout, monitor, spend, traffic

NOON, LW_NOON = (TODAY, "12:00:00"), (LAST_WEEK, "12:00:00")
OFFERS = [(1, "T1", TODAY)]


def summary_of(i, city=True):
    build = facts.city_facts if city else facts.state_facts
    return groups.group_summary(groups.group_hour_sums(build(i, PARAMS)), PARAMS)


def test_exact_copies_collapse_in_hourly_but_not_in_city(spark):
    copy = dict(order_bill=100.0, cart_discount=10.0)
    i = inputs(spark, [order(1, NOON, **copy), order(1, NOON, **copy), order(2, NOON, order_bill=50.0)])
    hourly = one(facts.hourly_report_kpis(i, PARAMS))
    assert (hourly["total_opd"], hourly["amv"], hourly["cdpo_po"]) == (2, 75.0, 5.0)
    city = one(facts.city_facts(i, PARAMS))
    # Two copies meet two special rows each: 4 x 10.
    assert (city["orders"], city["cdpo_sum"]) == (2, Decimal("40.00"))


def test_changed_copies_fan_out(spark):
    coupon = dict(coupon_code="SAVE", offer_totals=[("7",)], offer_details=[(1, 3.0)])
    i = inputs(
        spark,
        [order(1, NOON, order_bill=100.0, **coupon), order(1, NOON, order_bill=200.0, **coupon)],
        offers=OFFERS,
    )
    got = one(facts.hourly_report_kpis(i, PARAMS))
    assert got["total_opd"] == 1
    assert got["amv"] == 600.0  # (100 + 200) x 2
    assert got["special_po"] == 28.0  # 2 rows x 2 special rows x 7
    assert got["targeted_po"] == 24.0  # 4 joined rows x (3 + 3)
    inline = one(facts.hourly_report_kpis(i, PARAMS, fan_out=False))
    assert (inline["amv"], inline["special_po"], inline["targeted_po"]) == (300.0, 14.0, 12.0)


def test_normalised_lines_equal_nested_offers(spark):
    orders = [
        order(1, NOON, order_bill=1.0, offer_details=[(1, 3.0), (2, 5.0)]),
        order(1, NOON, order_bill=2.0, offer_details=[(1, 3.0), (2, 5.0)]),
        order(2, NOON, city=11, offer_details=[(1, 4.5)]),
        order(3, LW_NOON, offer_details=None),
    ]
    lines = [(1, 1, 3.0), (1, 2, 5.0), (2, 1, 4.5), (9, 1, 100.0)]
    events = [(1, "T1", TODAY), (2, "T2", TODAY)]
    nested = inputs(spark, orders, offers=events)
    flat = inputs(spark, orders, offers=events, lines=lines)
    for build in (facts.hourly_report_kpis, facts.city_facts, facts.state_facts):
        assert rows(build(nested, PARAMS), "*") == rows(build(flat, PARAMS), "*")


def test_joined_form_gives_the_same_sums(spark):
    """The literal joins of row, targeted spend and special spend, on copies in two cities."""
    coupon = dict(coupon_code="SAVE", offer_totals=[("2",)], offer_details=[(1, 3.0)])
    i = inputs(
        spark,
        [
            order(1, NOON, 10, cart_discount=1.0, **coupon),
            order(1, NOON, 10, cart_discount=2.0),
            order(1, NOON, 11, cart_discount=4.0, **coupon),
            order(2, NOON, 11, cart_discount=8.0),
        ],
        offers=OFFERS,
    )
    base = facts.grouped_orders(i, PARAMS, "city_name")
    base = spend.special_spend(base, i.special_coupons)
    base.createOrReplaceTempView("base")
    weights = spend.offer_weights(i.offer_events, i.templates, PARAMS)
    spend.nested_spend(base, weights, facts.KEY).createOrReplaceTempView("targeted")
    want = spark.sql(
        """SELECT b.grp, sum(b.cart_discount) AS cdpo, sum(t.spend_units) / 10000 AS targeted, sum(s.special_spend) AS special
           FROM base b LEFT JOIN targeted t USING (cluster, order_id, hr, dt)
           LEFT JOIN (SELECT cluster, order_id, hr, dt, special_spend FROM base) s USING (cluster, order_id, hr, dt)
           GROUP BY b.grp"""
    )
    got = facts.city_facts(i, PARAMS).selectExpr(
        "grp", *(f"cast({c}_sum AS double) AS {c}" for c in ("cdpo", "targeted", "special"))
    )
    assert rows(got, "*") == rows(want, "*")
    assert rows(got, "grp", "cdpo") == {("Alpha", 9.0), ("Beta", 20.0)}


def test_offer_under_two_listed_templates_counts_twice(spark):
    events = [(1, "T1", TODAY), (1, "T2", TODAY), (1, "T2", TODAY), (1, "OTHER", TODAY)]
    i = inputs(spark, [order(1, NOON, offer_details=[(1, 3.0)])], offers=events, templates=("T1", "T2"))
    assert one(facts.hourly_report_kpis(i, PARAMS))["targeted_po"] == 6.0
    assert spend.targeted_offers(i.offer_events, i.templates, PARAMS).count() == 2


def test_look_back_is_inclusive(spark):
    events = [(1, "T1", date(2023, 10, 31)), (2, "T1", date(2023, 11, 1))]
    i = inputs(spark, [], offers=events)
    assert rows(spend.targeted_offers(i.offer_events, i.templates, PARAMS), "offer_id") == {(2,)}


def test_cutoff_is_inclusive_to_the_second(spark):
    i = inputs(
        spark,
        [order(1, (TODAY, "12:30:15"))]
        + [order(n, (LAST_WEEK, t)) for n, t in ((2, "12:30:14"), (3, "12:30:15"), (4, "12:30:16"))],
    )
    kept = filters.comparable_orders(i.orders, i.cluster_dim, PARAMS)
    assert rows(kept, "order_id", "max_hms") == {(n, "12:30:15") for n in (1, 2, 3)}


def test_cutoff_ignores_excluded_rows_and_other_clusters(spark):
    i = inputs(
        spark,
        [
            order(1, (TODAY, "10:00:00")),
            order(2, (TODAY, "11:00:00"), excluded_flag=1),
            order(3, (TODAY, "13:00:00"), city=99),
            order(4, (LAST_WEEK, "10:30:00")),
        ],
    )
    kept = filters.comparable_orders(i.orders, i.cluster_dim, PARAMS)
    assert rows(kept, "order_id") == {(1,)}


def test_without_today_last_week_is_dropped_and_the_total_is_blank(spark):
    i = inputs(spark, [order(1, LW_NOON)])
    total = one(compare.hourly_report(i, PARAMS))
    assert (total["cluster"], total["hr"], total["pos"]) == ("tier_2", "Overall", 999)
    assert all(v is None for k, v in total.items() if k not in ("cluster", "hr", "pos"))
    meta = one(compare.report_meta(compare.hourly_report(i, PARAMS), PARAMS))
    assert (meta["latest_hr"], meta["detail_rows"], meta["has_total"]) == (0, 0, True)


def test_hour_of_last_week_only(spark):
    i = inputs(spark, [order(1, NOON), order(2, (LAST_WEEK, "11:00:00")), order(3, LW_NOON)])
    report = compare.hourly_report(i, PARAMS)
    assert rows(report, "hr", "total_opd", "lw_opd") == {("12", 1, 1), ("Overall", 1, 1)}
    grid = groups.group_hour_grid(groups.group_hour_sums(facts.city_facts(i, PARAMS)), PARAMS)
    assert rows(grid, "grp", "hr", "tw_orders", "lw_orders") == {("Alpha", 11, 0, 1), ("Alpha", 12, 1, 1)}


def test_total_weighs_rounded_hourly_rates(spark):
    orders = [
        order(1, (TODAY, "09:00:00"), order_bill=10.4),
        order(2, (TODAY, "10:00:00"), order_bill=20.0),
        order(3, (TODAY, "10:10:00"), order_bill=21.0),
        order(4, (TODAY, "11:00:00"), order_bill=30.0),
        order(5, (LAST_WEEK, "09:00:00"), order_bill=8.0),
    ]
    i = inputs(spark, orders, traffic=[bucket(9, "Alpha", 10, 5, 3, 1), bucket(10, "Alpha", 30, 20, 6, 2), bucket(20, "Alpha", 99)])
    report = compare.hourly_report(i, PARAMS)
    assert rows(report.where("pos < 999"), "hr", "amv", "sessions", "cvr") == {
        ("9", 10.0, 10, 30.0), ("10", 21.0, 30, 20.0), ("11", 30.0, None, None),
    }
    total = one(report, hr="Overall")
    # (10 x 1 + 21 x 2 + 30 x 1) / 4 = 20.5, from the rounded 20.5 -> 21 of ten o'clock.
    assert (total["total_opd"], total["lw_opd"], total["amv"], total["lw_amv"]) == (4, 1, 21.0, 8.0)
    assert total["amv_gr"] == 156.3  # (20.5 - 8) / 8, not from the rounded 21
    # Sessions only of hours with orders today.
    assert (total["sessions"], total["lw_sessions"], total["cvr"], total["lw_cvr"]) == (40, 25, 22.5, 12.0)
    assert (total["cvr_chg"], total["traffic_gr"], total["opd_gr"]) == (10.5, 60.0, 300.0)


def test_orders_in_two_hours_count_in_both(spark):
    i = inputs(spark, [order(1, (TODAY, "09:00:00")), order(1, (TODAY, "10:00:00"))])
    assert one(compare.hourly_report(i, PARAMS), hr="Overall")["total_opd"] == 2


def test_rows_without_time(spark):
    coupon = dict(coupon_code="SAVE", offer_totals=[("7",)], offer_details=[(1, 3.0)])
    i = inputs(spark, [order(1, None, cart_discount=1.0, **coupon), order(1, None, cart_discount=2.0, **coupon), order(2, NOON)], offers=OFFERS)
    city = one(facts.city_facts(i, PARAMS), hr=None)
    # A missing hour matches no joined row: no fan-out, no spend.
    assert (city["orders"], city["cdpo_sum"], city["special_sum"], city["targeted_sum"]) == (1, 3, 0, 0)
    sums = groups.group_hour_sums(facts.city_facts(i, PARAMS))
    assert rows(sums, "hr", "orders") == {(-1, 1), (12, 1)}
    assert rows(groups.group_hour_grid(sums, PARAMS), "hr") == {(12,)}
    assert one(groups.group_summary(sums, PARAMS))["tw_orders"] == 2


def test_two_spellings_of_a_city_each_get_the_traffic(spark):
    i = inputs(spark, [order(1, NOON, 10), order(2, NOON, 12)], traffic=[bucket(12, "ALPHA", 5), bucket(12, "alpha", 6)])
    assert rows(facts.city_facts(i, PARAMS), "grp", "orders", "sessions") == {("Alpha", 1, 11), ("alpha", 1, 11)}


def test_two_spellings_of_a_state_multiply_sums(spark):
    i = inputs(
        spark,
        [order(1, NOON, 10, cart_discount=5.0)],
        traffic=[bucket(12, "Alpha", 4), bucket(12, "Gamma", 7)],
        cities=[(10, "Alpha", "North"), (12, "Gamma", "north")],
    )
    state = one(facts.state_facts(i, PARAMS))
    assert (state["grp"], state["orders"], state["cdpo_sum"], state["sessions"]) == ("North", 1, 10, 7)


def test_repeated_city_name_multiplies_state_traffic(spark):
    i = inputs(spark, [], traffic=[bucket(12, "Alpha", 4)], cities=[(10, "Alpha", "North"), (13, "ALPHA", "North")])
    rows_ = traffic.cluster_traffic(i.traffic, i.cluster_classes, PARAMS)
    assert one(traffic.traffic_by_state(rows_, i.city_dim))["sessions"] == 8


def test_traffic_filters(spark):
    i = inputs(spark, [], traffic=[bucket(12, "Alpha", 1), bucket(12, "Alpha", 2, platform="Web"), bucket(12, "Alpha", 4, label="class_1"), bucket(12, "Alpha", 8, platform="Android")])
    assert one(traffic.traffic_by_hour(traffic.cluster_traffic(i.traffic, i.cluster_classes, PARAMS)))["sessions"] == 9


def test_unknown_city_code_drops_out_of_city_but_not_hourly(spark):
    i = inputs(spark, [order(1, NOON, 10), order(2, NOON, 77)], clusters=[(10, "tier_2"), (77, "tier_2")])
    assert one(facts.hourly_report_kpis(i, PARAMS))["total_opd"] == 2
    assert one(facts.city_facts(i, PARAMS))["orders"] == 1


def test_unknown_group_absorbs_null_and_empty_names(spark):
    i = inputs(spark, [order(1, NOON, 10), order(2, NOON, 11), order(3, NOON, 12)], cities=[(10, None, "N"), (11, "", "N"), (12, "Gamma", "N")])
    sums = groups.group_hour_sums(facts.city_facts(i, PARAMS))
    assert rows(sums, "grp", "orders") == {("Unknown", 2), ("Gamma", 1)}


def test_missing_and_malformed_offers(spark):
    coupon = dict(coupon_code="SAVE")
    i = inputs(
        spark,
        [
            order(1, NOON, offer_totals=None, offer_details=None, **coupon),
            order(2, NOON, offer_totals=[], offer_details=[], **coupon),
            order(3, NOON, offer_totals=[("zz",)], **coupon),
            order(4, NOON, offer_totals=[(None,)], **coupon),
            order(5, NOON, offer_totals=[("2.5",), ("9",)], offer_details=[(8, 1.0)], **coupon),
            order(6, NOON, offer_totals=[("4",)], coupon_code="OTHER"),
            order(7, NOON, offer_totals=[("4",)], coupon_code=None),
        ],
        offers=OFFERS,
    )
    got = rows(spend.special_spend(filters.comparable_days(i.orders, PARAMS), i.special_coupons), "order_id", "special_spend")
    assert got == {(n, None) for n in (1, 2, 3, 4, 6, 7)} | {(5, Decimal("2.50"))}
    assert rows(spend.explode_offers(filters.comparable_days(i.orders, PARAMS)), "order_id", "offer_id") == {(5, 8)}
    kpis = one(facts.hourly_report_kpis(i, PARAMS))
    assert (kpis["special_po"], kpis["targeted_po"]) == (0.36, 0.0)


def test_banner_and_coupon_predicates(spark):
    i = inputs(
        spark,
        [
            order(1, NOON, banner_factor=1.6, coupon_code=""),
            order(2, NOON, banner_factor=1.7, coupon_code="X"),
            order(3, NOON, banner_factor=None, coupon_code=None),
        ],
    )
    assert one(facts.hourly_report_kpis(i, PARAMS))["ob_pct"] == 33.3
    assert one(facts.city_facts(i, PARAMS))["coupon_orders"] == 1


def test_zero_denominators(spark):
    i = inputs(spark, [order(1, NOON, 10, cart_discount=5.0), order(2, LW_NOON, 11)], traffic=[bucket(12, "Alpha", 0, 0)])
    alpha = one(summary_of(i), grp="Alpha")
    assert (alpha["tw_orders"], alpha["lw_orders"], alpha["d_orders"]) == (1, 0, None)
    assert (alpha["tw_cdpo"], alpha["lw_cdpo"], alpha["d_cdpo"]) == (5.0, None, None)
    assert (alpha["tw_sessions"], alpha["tw_cvr"], alpha["d_sessions"]) == (0, None, None)
    beta = one(summary_of(i), grp="Beta")
    assert (beta["tw_orders"], beta["lw_orders"], beta["d_orders"]) == (0, 1, -100.0)
    wow = one(compare.hourly_rows(inputs(spark, [order(1, NOON)]), PARAMS))
    assert (wow["lw_opd"], wow["opd_gr"], wow["residual"], wow["lw_residual"]) == (None, None, 0.0, None)


def test_summary_changes_use_rounded_values_and_last_week_traffic_of_today(spark):
    i = inputs(
        spark,
        [order(1, NOON), order(2, NOON, coupon_code="X"), order(3, NOON), order(4, LW_NOON)],
        traffic=[bucket(12, "Alpha", 7, 9, 2, 4)],
    )
    got = one(summary_of(i))
    assert (got["tw_cvr"], got["lw_cvr"], got["d_cvr"]) == (28.57, 44.44, -15.87)
    assert (got["tw_sessions"], got["lw_sessions"], got["d_sessions"]) == (7, 9, -22.2)
    assert (got["tw_oc_pct"], got["lw_oc_pct"], got["d_oc_pct"]) == (33.3, 0.0, 33.3)
    assert got["d_orders"] == 200.0


def _grid(spark, cells):
    """A grid with the given (hour, tw_orders, lw_orders, tw_sessions, lw_sessions, tw_cvr, lw_cvr, tw_cdpo)."""
    schema = "cluster string, grp string, hr int, tw_orders bigint, lw_orders bigint, tw_sessions bigint, lw_sessions bigint, tw_cvr double, lw_cvr double, tw_cdpo double, lw_cdpo double, tw_oc_pct double, lw_oc_pct double"
    return spark.createDataFrame([("tier_2", "Alpha", *c, None, c[-1], None) for c in cells], schema)


def test_hour_reaggregation(spark):
    grid = _grid(spark, [(9, 2, 0, 10, 4, 30.0, None, None), (10, 4, 0, 30, 6, None, 0.0, None), (11, 9, 9, 9, 9, 9.0, 9.0, None)])
    got = one(groups.hour_reagg(grid, [9, 10]))
    # A missing rate weighs as zero, its sessions still count; a zero mean is missing.
    assert (got["tw_orders"], got["lw_orders"], got["d_orders"]) == (6, 0, None)
    assert (got["tw_sessions"], got["lw_sessions"], got["d_sessions"]) == (40, 10, 300.0)
    assert (got["tw_cvr"], got["lw_cvr"], got["d_cvr"]) == (7.5, None, None)


def test_heat_band(spark):
    cells = [(h, 0, 0, 0, 0, None, None, v) for h, v in ((1, 100.0), (2, 105.0), (3, 95.0), (4, 104.99), (5, 95.01), (6, 0.0), (7, None))]
    got = rows(layout.heat_tag(_grid(spark, cells), "cdpo"), "hr", "tag")
    assert got == {(1, ""), (2, "good"), (3, "bad"), (4, ""), (5, ""), (6, "bad"), (7, "")}
    # The inverted metric holds the same values.
    inverted = rows(layout.heat_tag(_grid(spark, cells), "oc_pct"), "hr", "tag")
    assert {t for h, t in inverted if h == 2} == {"bad"} and {t for h, t in inverted if h == 6} == {"good"}
    blank = rows(layout.heat_tag(_grid(spark, [(1, 0, 0, 0, 0, None, None, 0.0)]), "cdpo"), "tag")
    assert blank == {("",)}


def test_pivot_change_falls_back_to_difference(spark):
    grid = _grid(spark, [(9, 3, 0, 1, 1, 5.0, 2.0, None), (10, 3, 2, 1, 1, 5.0, None, None)])
    orders = one(layout.pivot_metric(grid, "orders"))
    assert (orders["h9_d"], orders["h10_d"], orders["h11_tw"], orders["h0_d"]) == (3.0, 50.0, None, None)
    cvr = one(layout.pivot_metric(grid, "cvr"))
    assert (cvr["h9_d"], cvr["h10_d"]) == (3.0, None)


def test_direction_tags(spark):
    values = spark.createDataFrame([(None,), (0.0,), (0.004,), (0.005,), (-1.0,), (float("nan"),)], "v double")
    plain = [r[0] for r in values.selectExpr(direction("v")).collect()]
    assert plain == ["na", "neu", "pos", "pos", "neg", "na"]
    banded = [r[0] for r in values.selectExpr(direction("v", "TRUE", 0.005)).collect()]
    assert banded == ["na", "neu", "neu", "neg", "pos", "na"]


@pytest.mark.parametrize(
    "value, digits, expected",
    [("1.005D", 2, 1.01), ("2.5D", 0, 3.0), ("-2.5D", 0, -3.0), ("0.125D", 2, 0.13), ("155D / 1000", 2, 0.16)],
)
def test_ties_round_away_from_zero(spark, value, digits, expected):
    assert spark.range(1).selectExpr(rounded(value, digits)).collect()[0][0] == expected


def test_sort_puts_nulls_last_both_ways(spark):
    data = spark.createDataFrame([("c", "a", 1.0), ("c", "b", None), ("c", "d", 3.0)], "cluster string, grp string, d_cvr double")
    assert rows(layout.sort_nulls_last(data, "d_cvr"), "grp", "pos_asc", "pos_desc") == {("a", 1, 2), ("d", 2, 1), ("b", 3, 3)}


def test_peak_hour_prefers_the_later_of_equals(spark):
    i = inputs(spark, [order(n, (TODAY, f"{h:02d}:00:00")) for n, h in ((1, 9), (2, 10), (3, 9), (4, 10), (5, 11))])
    assert one(monitor.peak_hour(facts.city_facts(i, PARAMS), PARAMS))["peak_hr"] == 10


def test_trailing_series_and_choice_of_hour(spark):
    grid = _grid(spark, [(h, h, 0, 0, 0, None, None, None) for h in range(10)])
    got = one(monitor.trailing_hours(grid, 8))
    assert (got["series"], got["avg_7"]) == ("2,3,4,5,6,7,8", 5.0)


def test_delay_severities(spark):
    minutes = {1: "14:37:01", 2: "14:36:00", 3: "14:34:00", 4: "14:32:00", 5: "14:33:00"}
    i = inputs(spark, [order(n, (TODAY, t)) for n, t in minutes.items()])
    # 7, 9, 11, 13 and 12 minutes.
    got = one(monitor.delayed_count(filters.comparable_days(i.orders, PARAMS), PARAMS))
    assert (got["delayed"], got["high"], got["medium"]) == (3, 1, 3)


def test_status_tiers_at_the_thresholds(spark):
    facts_ = spark.createDataFrame([("c", "g", h, TODAY, n) for h, n in ((1, 5001), (2, 5000), (3, 3000))], "cluster string, grp string, hr int, dt date, orders bigint")
    assert rows(monitor.status_tiers(facts_, PARAMS), "hr", "status") == {(1, "CRITICAL"), (2, "WARNING"), (3, "NORMAL")}


def test_pick_without_values_keeps_all(spark):
    data = spark.createDataFrame([("a",), ("b",)], "grp string")
    assert filters.pick(data, "grp", []).count() == 2
    assert rows(filters.pick(data, "grp", ["b"]), "grp") == {("b",)}


def test_dayparts_and_partial_hour(spark):
    i = inputs(spark, [order(n, (TODAY, f"{h:02d}:00:00")) for n, h in enumerate((5, 6, 11, 12, 14))])
    assert rows(compare.daypart_rollup(facts.hourly_report_kpis(i, PARAMS)), "daypart", "total_opd") == {("late_night", 1), ("morning", 2), ("lunch", 2)}
    assert rows(compare.mark_partial_hour(compare.hourly_rows(i, PARAMS)).where("is_partial"), "hr") == {("14",)}


def test_membership_in_two_clusters(spark):
    i = inputs(spark, [order(1, NOON)], clusters=[(10, "tier_2"), (10, "tier_next"), (10, "tier_9")])
    both = replace(PARAMS, clusters=("tier_2", "tier_next"))
    assert rows(filters.comparable_orders(i.orders, i.cluster_dim, both), "cluster") == {("tier_2",), ("tier_next",)}
