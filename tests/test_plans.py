"""What the physical plans must and must not contain."""

import re
from contextlib import contextmanager
from dataclasses import replace

import pytest

import __spark_entry__ as contract
from weekover.plans import catalog
from weekover.operators import compare, facts, filters, spend
from weekover.sources import retail, schemas, tables
from weekover.sources.inputs import FrameInputs

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


EAGER = ("snapshot_", "incremental_", "cutoff_prefix", "all_reports", "hourly_bucketed", "offers_sliding")
LAZY = sorted(name for name in catalog.REGISTRY if not name.startswith(EAGER))


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert node not in text, node


def test_small_dimensions_are_broadcast_by_their_size(spark):
    text = plan(contract.queries()["city_base"](spark, SF_DIR))
    assert text.count("BroadcastHashJoin") >= 4
    assert "SortMergeJoin" not in text


def test_only_bounded_frames_are_broadcast_when_sizes_are_unknown(spark):
    """With Spark's own broadcasts off, what stays hinted has one row per cluster."""
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        text = plan(contract.queries()["group_hour_grid"](spark, SF_DIR))
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", text)
    assert joins and all(re.fullmatch(r"cluster#\d+", j) for j in joins)


def test_grid_reads_the_facts_once(spark):
    """One scan of the events for the cutoff, one for the rows and one, of two columns, for
    the orders whose lines are needed, besides the traffic."""
    text = plan(contract.queries()["group_hour_grid"](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet \[event_id", text)) == 3
    assert len(re.findall(r"FileScan parquet \[event_id#\d+L?,ts#\d+\]", text)) == 1


def test_day_filter_and_columns_reach_the_scan(spark):
    with settings(spark, **{"spark.sql.maxMetadataStringLength": "2000"}):
        text = plan(contract.queries()["hourly_kpis"](spark, SF_DIR))
    events = [s for s in re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[(.*?)\], ReadSchema", text) if "ts#" in s[0]]
    assert events
    for columns, pushed in events:
        assert "GreaterThanOrEqual(ts,2024-01-30T00:00)" in pushed and "props" not in columns
    lineitem = re.search(r"FileScan parquet \[(l_[^\]]*)\]", text).group(1)
    assert re.sub(r"#\d+L?", "", lineitem) == "l_orderkey,l_partkey,l_quantity"


def test_partitioned_orders_are_pruned_to_the_two_days(spark, tmp_path):
    p = retail.default_params()
    i = retail.RetailInputs(spark, SF_DIR, p)
    tables.write_by_day(i.orders, str(tmp_path / "order_facts"))
    stored = spark.read.parquet(str(tmp_path / "order_facts"))
    text = plan(filters.comparable_days(stored, p))
    assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ (IN|INSET|=)", text)
    assert stored.count() == i.orders.count()


def test_canonical_tables_read_back(spark, tmp_path):
    """A report over stored canonical tables with nested offers equals the one over frames."""
    from frames import PARAMS, bucket, inputs, order, rows, TODAY, LAST_WEEK

    noon, lw = (TODAY, "12:00:00"), (LAST_WEEK, "12:00:00")
    i = inputs(
        spark,
        [order(1, noon, offer_details=[(1, 3.0)], order_bill=5.0), order(2, noon, 11), order(3, lw, offer_details=[(1, 2.0)])],
        traffic=[bucket(12, "Alpha", 4)],
        offers=[(1, "T1", TODAY)],
    )
    root = str(tmp_path)
    tables.write_by_day(i.orders, f"{root}/order_facts")
    tables.write_by_day(i.offer_events, f"{root}/offer_events")
    for name, df in (("templates", i.templates), ("special_coupons", i.special_coupons), ("city_dim", i.city_dim),
                     ("cluster_dim", i.cluster_dim), ("cluster_classes", i.cluster_classes), ("traffic_buckets", i.traffic)):
        df.write.parquet(f"{root}/{name}")
    stored = tables.read_inputs(spark, root)
    assert isinstance(stored, FrameInputs) and stored.orders.schema["offer_details"] == schemas.ORDER_FACTS["offer_details"]
    assert rows(compare.hourly_report(stored, PARAMS), "*") == rows(compare.hourly_report(i, PARAMS), "*")
    assert rows(facts.city_facts(stored, PARAMS), "*") == rows(facts.city_facts(i, PARAMS), "*")


@pytest.mark.parametrize("name", ["hourly_overall", "city_hourly", "state_summary", "group_hour_grid", "targeted_spend"])
def test_same_rows_with_shuffled_joins(spark, name):
    """The plan for tables too large to broadcast gives the same rows."""
    def result():
        return sorted(map(repr, contract.queries()[name](spark, SF_DIR).collect()))

    want = result()
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        assert result() == want


def test_nested_orders_are_scanned_twice_at_most(spark, tmp_path):
    """Once for the cutoff and once for everything else."""
    from frames import PARAMS, TODAY, inputs, order

    i = inputs(spark, [order(1, (TODAY, "12:00:00"), offer_details=[(1, 3.0)])], offers=[(1, "T1", TODAY)])
    path = str(tmp_path / "order_facts")
    tables.write_by_day(i.orders, path)
    stored = FrameInputs(**{**vars(i), "orders": spark.read.schema(schemas.ORDER_FACTS).parquet(path)})
    for report in (facts.city_facts, facts.state_facts, compare.hourly_report):
        text = plan(report(stored, PARAMS))
        scans = len(re.findall(r"FileScan parquet \[[^\]]*order_id", text))
        assert scans - text.count("ReusedExchange") <= 2, report.__name__


def test_bucketed_orders_are_not_shuffled(spark, tmp_path):
    """Rows of an order meet each other and their lines as they are stored; so do they when nothing is broadcast."""
    p = retail.default_params()
    i = retail.RetailInputs(spark, SF_DIR, p)
    stored = {
        name: tables.write_bucketed(rows, f"{name}_{tmp_path.name}", str(tmp_path / name), 4)
        for name, rows in (("orders", i.orders), ("lines", i.offer_lines))
    }
    flat = FrameInputs(**{n: getattr(i, n) for n in FrameInputs.__dataclass_fields__})
    bucketed = replace(flat, orders=stored["orders"], offer_lines=stored["lines"])
    expected = facts.hourly_orders(flat, p)
    weights = spend.offer_weights(i.offer_events, i.templates, p)
    for merged in (False, True):
        with settings(spark, **tables.BUCKETED):
            rows = facts.distinct_rows(filters.comparable_orders(bucketed.orders, bucketed.cluster_dim, p))
            joined = facts.order_level(rows, bucketed, p)
            if merged:
                lines = spend.order_spend(bucketed.offer_lines, weights).hint("merge")
                joined = joined.drop("spend_units").join(lines, ["order_id", "dt"], "left")
            else:
                assert sorted(map(str, joined.collect())) == sorted(map(str, expected.collect()))
            text = plan(joined)
        shuffled = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
        assert all("order_id" not in keys for keys in shuffled), shuffled
        assert text.count("Bucketed: true") >= 2 and ("SortMergeJoin" in text or not merged)


def test_lines_are_pruned_by_the_offers(spark, tmp_path):
    """Spark's runtime filter on the line scan comes from stored weights, not from their aggregate."""
    p = retail.default_params()
    i = retail.RetailInputs(spark, SF_DIR, p)
    i.offer_lines.select("order_id", "dt", "offer_id", "discount").write.partitionBy("dt").parquet(str(tmp_path / "lines"))
    lines = spark.read.schema(schemas.OFFER_LINES).parquet(str(tmp_path / "lines"))
    weights = spend.stored_weights(spend.offer_weights(i.offer_events, i.templates, p), str(tmp_path / "weights"))
    found = {}
    for on in ("true", "false"):
        runtime = {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.enabled": on,
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        }
        with settings(spark, **runtime):
            spent = spend.order_spend(spend.compared_lines(lines, i.orders, p), weights)
            text = spent._jdf.queryExecution().optimizedPlan().toString()
            found[on] = sorted(map(str, spent.collect()))
        filtered = [x for x in text.splitlines() if "might_contain" in x]
        assert any("dt#" in x and " IN (" in x for x in filtered) == (on == "true")
    assert found["true"] == found["false"] != []
