"""The incremental refresh over several batches, clocks, restarts and replays."""

from dataclasses import replace

import pytest
from frames import LAST_WEEK, PARAMS, TODAY, inputs, order, rows

from weekover.operators import compare, snapshot
from weekover.sources import retail, schemas
from weekover.streaming import refresh

SF_DIR = "/root/testdata/sf0.001"
P = retail.default_params()


def _inputs(spark, p):
    return refresh.with_lines(retail.RetailInputs(spark, SF_DIR, p), retail.all_lines(spark, SF_DIR))


def _run(spark, folder, work, root, p=P):
    events = refresh.file_stream(spark, folder, retail.TABLES["events"], "part-*.parquet", files_per_batch=1)
    refresh.run_refresh(retail.order_stream(events, spark, SF_DIR), _inputs(spark, p), work, root, p)


def _at(hour, minute=0):
    return replace(P, as_of=P.as_of.replace(hour=hour, minute=minute))


def _stored(spark, root):
    return snapshot.read_snapshot(spark, root, "hourly").drop("as_of")


def _report(spark, p):
    return compare.hourly_report(retail.RetailInputs(spark, SF_DIR, p), p)


def test_rows_ahead_of_the_clock_are_kept_for_later_runs(spark, tmp_path):
    events, work, root = (str(tmp_path / n) for n in ("events", "work", "stored"))
    all_events = retail.table(spark, SF_DIR, "events")
    all_events.where("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(events)
    _run(spark, events, work, root, _at(11))
    part = rows(_stored(spark, root), "*")
    all_events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(events)
    # A new query on the same checkpoint reads only the new file.
    _run(spark, events, work, root, _at(11))
    report = _report(spark, _at(11))
    assert rows(_stored(spark, root).select(report.columns), "*") == rows(report, "*") != part
    # Nothing new arrives, but the clock moves on.
    _run(spark, events, work, root)
    report = _report(spark, P)
    assert rows(_stored(spark, root).select(report.columns), "*") == rows(report, "*")


def test_a_batch_that_failed_half_way_is_replayed_once(spark, tmp_path, monkeypatch):
    events, work, root = (str(tmp_path / n) for n in ("events", "work", "stored"))
    retail.table(spark, SF_DIR, "events").coalesce(1).write.parquet(events)

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(snapshot, "publish", fail)
    with pytest.raises(Exception, match="lost"):
        _run(spark, events, work, root)
    with pytest.raises(Exception):
        _stored(spark, root)
    monkeypatch.undo()
    _run(spark, events, work, root)
    schema = retail.order_stream(retail.table(spark, SF_DIR, "events"), spark, SF_DIR).schema
    landed = refresh.landed_orders(spark, f"{work}/landing", schema, P)
    orders = retail.order_facts(
        retail.table(spark, SF_DIR, "events"), retail.table(spark, SF_DIR, "orders"), retail.table(spark, SF_DIR, "customer")
    )
    assert landed.count() == orders.where(retail.F.col("dt").isin(P.today, P.last_week)).count()
    report = _report(spark, P)
    assert rows(_stored(spark, root).select(report.columns), "*") == rows(report, "*")


def test_batch_of_other_clusters_leaves_a_cluster_alone(spark, tmp_path):
    events, work, root = (str(tmp_path / n) for n in ("events", "work", "stored"))
    all_events = retail.table(spark, SF_DIR, "events")
    owner = retail.table(spark, SF_DIR, "orders").join(
        retail.table(spark, SF_DIR, "customer").where("c_nationkey < 5"), retail.F.expr("o_custkey = c_custkey")
    )
    only_first = all_events.join(owner, all_events.event_id == owner.o_orderkey, "left_semi")
    only_first.coalesce(1).write.mode("append").parquet(events)
    _run(spark, events, work, root)
    assert rows(snapshot.read_snapshot(spark, root, "hourly"), "cluster") == {("tier_1",)}


def test_canonical_rows_with_nested_offers(spark, tmp_path):
    folder, work, root = (str(tmp_path / n) for n in ("orders", "work", "stored"))
    noon, lw = (TODAY, "12:00:00"), (LAST_WEEK, "12:00:00")
    first = [order(1, noon, offer_details=[(1, 3.0)], order_bill=5.0), order(3, lw, offer_details=[(1, 2.0)])]
    second = [order(2, noon, 11, offer_details=[(1, 1.0), (2, 9.0)]), order(9, (TODAY, "20:00:00"))]
    everything = inputs(spark, first + second, offers=[(1, "T1", TODAY)])
    for part in (first, second):
        spark.createDataFrame(part, schemas.ORDER_FACTS).coalesce(1).write.mode("append").parquet(folder)
        stream = refresh.file_stream(spark, folder, schemas.ORDER_FACTS, "part-*.parquet")
        refresh.run_refresh(stream, everything, work, root, PARAMS)
    report = compare.hourly_report(everything, PARAMS)
    assert rows(_stored(spark, root).select(report.columns), "*") == rows(report, "*")


def test_compacted_rows_are_the_same(spark, tmp_path):
    landing, target = str(tmp_path / "landing"), str(tmp_path / "compacted")
    facts = spark.createDataFrame([order(i, (TODAY, "10:00:00")) for i in range(6)], schemas.ORDER_FACTS)
    for batch_id in range(3):
        refresh.land(facts.where(f"order_id % 3 = {batch_id}"), batch_id, landing)
    refresh.compact(spark, landing, target, facts.schema)
    landed = [rows(refresh.landed_orders(spark, f, facts.schema, PARAMS).select("order_id", "dt"), "*") for f in (landing, target)]
    assert landed[0] == landed[1] and len(landed[0]) == 6
