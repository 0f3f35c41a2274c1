"""Three reports from one stage against the reports by themselves."""

from dataclasses import replace

import pytest
from frames import LAST_WEEK, TODAY, inputs, order, rows
from test_delta import OFFERS, TRAFFIC, TREE, TREE_P, drawn

from weekover.operators import compare, facts, stage

CITIES = [(10, "Alpha", "North"), (11, "Beta", "South"), (12, "alpha", "north"), (12, "Gamma", "South")]


def same(found, expected):
    return rows(found.select(expected.columns), "*") == rows(expected, "*")


@pytest.mark.parametrize("seed", [21, 22, 23])
def test_reports_over_drawn_orders(spark, seed, tmp_path):
    """Copies in several cities, cities with two names, orders without id or time, moving cutoffs."""
    i = inputs(spark, drawn(seed), TRAFFIC, OFFERS, ("T1", "T2"), cities=CITIES, clusters=TREE)
    p = replace(TREE_P, as_of=TREE_P.as_of.replace(hour=11, minute=30))
    found = stage.reports(i, p, str(tmp_path / "stage"))
    assert same(found.hourly(), compare.hourly_report(i, p))
    assert same(found.city(), facts.city_facts(i, p))
    assert same(found.state(), facts.state_facts(i, p))


def test_lines_beside_the_orders(spark, tmp_path):
    orders = [order(k, (day, "10:00:00"), 10 + k % 2, cart_discount=1.0) for k in (1, 1, 2, 3) for day in (TODAY, LAST_WEEK)]
    lines = [(k, day, k, 2.0) for k in (1, 2, 3) for day in (TODAY, LAST_WEEK)]
    i = inputs(spark, orders, TRAFFIC, OFFERS, ("T1", "T2"), cities=CITIES, clusters=TREE, lines=lines)
    found = stage.reports(i, TREE_P, str(tmp_path / "stage"))
    assert same(found.hourly(), compare.hourly_report(i, TREE_P))
    assert same(found.city(), facts.city_facts(i, TREE_P))


def test_orders_are_scanned_once(spark, tmp_path):
    path = str(tmp_path / "orders")
    i = inputs(spark, drawn(24), TRAFFIC, OFFERS, ("T1", "T2"), cities=CITIES, clusters=TREE)
    i.orders.write.parquet(path)
    i = replace(i, orders=spark.read.schema(i.orders.schema).parquet(path))
    plan = stage.order_stage(i, TREE_P)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    found = stage.reports(i, TREE_P, str(tmp_path / "stage"))
    for report in (found.hourly(), found.city(), found.state()):
        scans = [x for x in report._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x]
        assert scans and not any(path in x for x in scans)


def test_an_order_of_many_copies_is_a_few_rows(spark, tmp_path):
    many = [order(1, (TODAY, "10:00:00"), order_bill=float(k % 3)) for k in range(3000)]
    i = inputs(spark, many, clusters=TREE)
    found = stage.reports(i, TREE_P, str(tmp_path / "stage"))
    assert found.stage.count() == 2
    assert {r.copies for r in found.hourly_orders().collect()} == {3}


def test_no_orders(spark, tmp_path):
    i = inputs(spark, [], clusters=TREE)
    found = stage.reports(i, TREE_P, str(tmp_path / "stage"))
    assert same(found.hourly(), compare.hourly_report(i, TREE_P)) and found.city().count() == 0
