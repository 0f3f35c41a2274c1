"""Stored results, shared folders, the clock on canonical inputs, and odd amounts."""

from dataclasses import replace
from decimal import Decimal
from types import SimpleNamespace

import pytest
from frames import LAST_WEEK, PARAMS, TODAY, bucket, inputs, one, order, rows

from weekover import metrics
from weekover.operators import compare, facts, snapshot, spend
from weekover.session import shared_folder
from weekover.sources import schemas

NOON, LW_NOON = (TODAY, "12:00:00"), (LAST_WEEK, "12:00:00")


def test_crash_before_publishing_leaves_the_former_result(spark, tmp_path):
    root = str(tmp_path)
    report = compare.hourly_report(inputs(spark, [order(1, NOON)]), PARAMS)
    snapshot.write_snapshot(report, root, "hourly", PARAMS)
    later = replace(PARAMS, as_of=PARAMS.as_of.replace(hour=15))
    snapshot.write_run(report, root, "hourly", later)
    assert rows(snapshot.read_snapshot(spark, root, "hourly"), "as_of") == {(PARAMS.as_of_text,)}


def test_empty_result_replaces_the_former_one(spark, tmp_path):
    root = str(tmp_path)
    report = compare.hourly_report(inputs(spark, [order(1, NOON)]), PARAMS)
    snapshot.write_snapshot(report, root, "hourly", PARAMS)
    snapshot.write_snapshot(report.limit(0), root, "hourly", PARAMS)
    stored = snapshot.read_snapshot(spark, root, "hourly")
    assert stored.count() == 0 and set(report.columns) < set(stored.columns)
    with pytest.raises(LookupError):
        snapshot.read_snapshot(spark, root, "hourly", "tier_9")


def _session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder, set=lambda key, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        shared_folder(_session(master), "x")
    assert shared_folder(_session(master, "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")


@pytest.mark.parametrize("master", ["local", "local[8]"])
def test_a_local_session_gets_a_folder(master):
    assert "weekover-" in shared_folder(_session(master), "x")


def test_clock_on_canonical_inputs(spark):
    orders = [order(1, (TODAY, "10:00:00")), order(2, (TODAY, "20:00:00")), order(3, (TODAY, "11:00:00"))]
    i = inputs(spark, orders, traffic=[bucket(10, "Alpha", 4), bucket(12, "Alpha", 9)], offers=[(1, "T1", TODAY)])
    p = replace(PARAMS, as_of=PARAMS.as_of.replace(hour=11, minute=0))
    report = compare.hourly_report(i, p)
    assert one(report, hr="Overall")["total_opd"] == 2
    assert rows(report.where("hr <> 'Overall'"), "hr", "sessions") == {("10", 4), ("11", None)}
    assert one(compare.report_meta(report, p), cluster="tier_2")["latest_hr"] == 11
    tomorrow = replace(p, as_of=p.as_of.replace(month=1, day=29))
    assert spend.targeted_offers(i.offer_events, i.templates, tomorrow).count() == 0


@pytest.mark.parametrize("text", ["NaN", "1e30", "Infinity", "zz", ""])
def test_offer_totals_that_are_no_amounts(spark, text):
    odd = order(1, NOON, coupon_code="SAVE", offer_totals=[(text,)])
    good = order(2, NOON, coupon_code="SAVE", offer_totals=[("8",)])
    assert one(facts.hourly_report_kpis(inputs(spark, [odd, good]), PARAMS), dt=TODAY)["special_po"] == 4.0


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), 1e30])
def test_money_that_is_no_amount_empties_its_cells_only(spark, bad):
    orders = [order(1, NOON, order_bill=bad, cart_discount=2.0), order(2, NOON, order_bill=3.0, cart_discount=4.0)]
    orders += [order(3, (TODAY, "13:00:00"), order_bill=6.0), order(4, LW_NOON, order_bill=7.0)]
    kpis = facts.hourly_report_kpis(inputs(spark, orders), PARAMS)
    assert rows(kpis, "hr", "dt", "amv", "cdpo_po") == {
        (12, TODAY, None, 3.0), (13, TODAY, 6.0, 0.0), (12, LAST_WEEK, 7.0, 0.0)
    }
    assert compare.hourly_report(inputs(spark, orders), PARAMS).count() == 3


def test_amounts_are_exact_to_four_decimals(spark):
    orders = [order(i, NOON, cart_discount=0.005) for i in range(4)] + [order(9, NOON, cart_discount=0.0001)]
    assert one(facts.city_facts(inputs(spark, orders), PARAMS), hr=12)["cdpo_sum"] == Decimal("0.0201")


def test_hot_offer_is_split(spark):
    """With a third of the lines under one offer the join of lines and offers is a skew join."""
    lines = [(i, TODAY, 1 if i % 3 else i, 1.0) for i in range(60_000)]
    frame = spark.createDataFrame(lines, schemas.OFFER_LINES).repartition(8)
    weights = spend.offer_weights(
        spark.createDataFrame([(i, "T1", TODAY) for i in range(2000)], schemas.OFFER_EVENTS),
        spark.createDataFrame([("T1",)], schemas.TEMPLATES),
        PARAMS,
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = spend.weighted_lines(frame, weights)
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_by_day_are_pruned(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(1, TODAY, 1, 1.0), (2, LAST_WEEK, 1, 1.0), (3, TODAY.replace(day=1), 1, 1.0)], schemas.OFFER_LINES).write.partitionBy("dt").parquet(path)
    kept = spend.compared_lines(spark.read.schema(schemas.OFFER_LINES).parquet(path), None, PARAMS)
    assert kept.count() == 2
    assert "PartitionFilters: [isnotnull(dt" in kept._jdf.queryExecution().executedPlan().toString() or "dt#" in str(
        kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]
    )


def test_lines_without_a_day_follow_their_orders(spark):
    i = inputs(spark, [order(1, NOON), order(2, (TODAY.replace(day=2), "12:00:00"))], lines=[(1, 7, 2.0), (2, 7, 3.0)])
    kept = spend.compared_lines(i.offer_lines, i.orders, PARAMS)
    assert rows(kept, "order_id", "dt", "discount") == {(1, TODAY, 2.0)}


# What each metric of the hourly report is: kind of change, digits of the value and of the
# change, and whether a fall is good. Stated here anew, since engine and SQL share one table.
HOURLY = {
    "total_opd": ("growth", 0, 1, False),
    "sessions": ("growth", 0, 1, False),
    "cvr": ("point", 2, 2, False),
    "ob_pct": ("point", 1, 1, True),
    "amv": ("growth", 0, 1, False),
    "cdpo_po": ("point", 2, 2, False),
    "sdpo_po": ("point", 2, 2, False),
    "rdpo_po": ("point", 2, 2, False),
    "targeted_po": ("point", 2, 2, False),
    "special_po": ("point", 2, 2, False),
    "residual": ("point", 2, 2, False),
}


def test_metric_table():
    table = {m.tw: (m.change_kind, m.digits, m.change_digits, m.inverted) for m in metrics.HOURLY_METRICS}
    assert table == HOURLY
    assert metrics.GROWTH_METRICS == {"orders", "sessions"} and metrics.INVERTED_METRICS == {"oc_pct"}
