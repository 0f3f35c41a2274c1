"""Sums by second against the report over the rows, and the store that batches change."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from frames import LAST_WEEK, PARAMS, TODAY, bucket, inputs, order, rows

from weekover.operators import compare, prefix, snapshot
from weekover.sources import schemas
from weekover.streaming import delta, refresh

P = replace(PARAMS, clusters=("tier_2", "tier_next"))
CLUSTERS = [(10, "tier_2"), (10, "tier_next"), (11, "tier_2"), (12, "tier_next")]
OFFERS = [(1, "T1", TODAY), (2, "T1", TODAY), (2, "T2", LAST_WEEK), (3, "T9", TODAY)]
TRAFFIC = [bucket(10, "Alpha", 4, 2, 1, 1), bucket(11, "Beta", 9, 3, 2, 1)]


def drawn(seed, n=90):
    """Few orders over few seconds, so that copies, changed rows and cutoffs meet."""
    random.seed(seed)
    pick = random.choice
    found = []
    for _ in range(n):
        day, clock = pick([TODAY, LAST_WEEK]), pick(["09:59:59", "10:00:00", "10:00:01", "11:30:00", "11:30:05", "20:00:00"])
        values = dict(
            offer_details=pick([None, [], [(1, 3.0)], [(1, 2.0), (2, 1.5), (3, 9.0)]]),
            offer_totals=pick([[], [("8",)], [("zz",)]]),
            coupon_code=pick([None, "", "SAVE", "X"]),
            order_bill=pick([5.0, 7.25, None, float("nan") if seed % 2 else 1.0]),
            cart_discount=pick([0.5, 2.0]),
            banner_factor=pick([1.6, 1.7, None]),
            excluded_flag=pick([0, 0, 0, 1]),
        )
        row = order(pick([1, 2, 3, 4, 5, None]), pick([(day, clock)] * 9 + [None]), pick([10, 10, 11, 12, 99]), **values)
        if row[1] is not None and random.random() < 0.3:
            row = (row[0], row[1] + timedelta(milliseconds=pick([0, 400])), *row[2:])
        found += [row] * pick([1, 1, 2])
    return found


def everything(spark, orders, offers=OFFERS):
    return inputs(spark, orders, TRAFFIC, offers, templates=("T1", "T2"), clusters=CLUSTERS)


def at(hour, minute=0, second=0):
    return replace(P, as_of=P.as_of.replace(hour=hour, minute=minute, second=second))


def same(report, full):
    return rows(report.select(full.columns), "*") == rows(full, "*")


def frame(spark, orders):
    return spark.createDataFrame(orders, schemas.ORDER_FACTS)


@pytest.mark.parametrize("seed", [1, 2])
def test_moving_clock(spark, seed, tmp_path):
    i = everything(spark, drawn(seed))
    prefix.running_sums(prefix.partials(i.orders, i, P)).write.parquet(str(tmp_path / "sums"))
    running = spark.read.parquet(str(tmp_path / "sums"))
    for p in (at(10), at(10, 0, 1), at(23, 59, 59)):
        assert same(prefix.hourly_report(running, i, p), compare.hourly_report(i, p))


def test_stored_sums_answer_without_orders(spark, tmp_path):
    i = everything(spark, drawn(5))
    prefix.running_sums(prefix.partials(i.orders, i, P)).write.parquet(str(tmp_path / "sums"))
    today, before = prefix.at_clock(spark.read.parquet(str(tmp_path / "sums")), at(11, 30))
    for sums in (today, before):
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert "offer_totals" not in plan and "order_id" not in plan


PARENTS = {"tier_next": ("tier_2", "tier_3")}
TREE = [(10, "tier_2"), (10, "tier_next"), (11, "tier_3"), (11, "tier_next"), (12, "tier_3"), (12, "tier_next")]
TREE_P = replace(PARAMS, clusters=("tier_2", "tier_3", "tier_next"))


@pytest.mark.parametrize("seed", [9])
def test_clusters_that_consist_of_others(spark, seed):
    """Orders of few ids have rows in both members, copies of rows too."""
    i = inputs(spark, drawn(seed), TRAFFIC, OFFERS, ("T1", "T2"), clusters=TREE)
    p = replace(TREE_P, as_of=P.as_of.replace(hour=11, minute=30))
    assert not prefix.spread_orders(i.orders, i.cluster_dim, replace(p, clusters=("tier_2", "tier_3"))).isEmpty()
    running = prefix.running_sums(prefix.rolled_up(i.orders, i, p, PARENTS))
    assert same(prefix.hourly_report(running, i, p), compare.hourly_report(i, p))


def test_rows_are_carried_once(spark):
    """The rows that orders are reduced from are as many as there are, whatever clusters consist of others."""
    orders = [order(k, (TODAY, "10:00:00"), 10 + k % 3) for k in range(30)]
    i = inputs(spark, orders, clusters=TREE)
    carried, real = [], prefix.order_rows
    count = lambda o, *more: carried.append(real(o, *more)) or carried[-1]
    prefix.order_rows = count
    try:
        prefix.rolled_up(i.orders, i, TREE_P, PARENTS).collect()
    finally:
        prefix.order_rows = real
    assert [frame.count() for frame in carried] == [30, 0, 0]


def test_fractions_of_a_clock(spark):
    with pytest.raises(ValueError, match="whole second"):
        prefix.clock_second(replace(P, as_of=datetime(2024, 1, 30, 14, 45, 0, 5)))


def test_rows_of_an_order_are_groups_of_seconds(spark):
    """An order with a third of all rows is added up by second before its steps are put in order."""
    many = [order(1, (TODAY, f"10:00:{k % 60:02d}"), order_bill=float(k)) for k in range(3000)]
    others = [order(2 + k, (TODAY, "10:00:00")) for k in range(6000)]
    i = everything(spark, many + others)
    sums = prefix.partials(i.orders, i, P)
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [step")
    assert sums.where("cluster = 'tier_2'").agg({"n_orders": "sum"}).first()[0] == 6001


@pytest.mark.parametrize("seed", [3, 4])
def test_batches_in_any_order(spark, seed, tmp_path):
    """Late, changed and repeated rows over several batches give the report over all of them."""
    orders = drawn(seed)
    random.shuffle(orders)
    parts = [orders[:50], orders[30:90], orders[90:], orders[:10]]
    store = delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS)
    i = everything(spark, orders)
    for batch_id, part in enumerate(parts):
        assert store.apply(frame(spark, part), batch_id, i, P)
        assert not store.apply(frame(spark, part), batch_id, i, P)
        if batch_id == 1:
            assert store.compact(P)
            before = store.sums().count()
            assert prefix.summed(store.sums()).count() == before
    for p in (at(10), at(20)):
        assert same(store.report(i, p), compare.hourly_report(i, p))
    assert len(store.vacuum()) > 2
    assert same(store.report(i, P), compare.hourly_report(i, P))


def test_lines_beside_the_orders(spark, tmp_path):
    orders = [order(k, (day, "10:00:00"), 10, cart_discount=float(k)) for k in range(1, 7) for day in (TODAY, LAST_WEEK)]
    lines = [(k, 1 + k % 3, 2.0) for k in range(1, 7)] * 2
    i = inputs(spark, orders, TRAFFIC, OFFERS, ("T1", "T2"), clusters=CLUSTERS, lines=lines)
    store = delta.DeltaStore(spark, str(tmp_path), i.orders.schema)
    store.apply(i.orders.where("order_id < 4"), 0, i, P)
    store.apply(i.orders.where("order_id >= 3"), 1, i, P)
    assert same(store.report(i, P), compare.hourly_report(i, P))


def test_a_batch_reads_its_own_orders_only(spark, tmp_path, monkeypatch):
    store = delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS)
    orders = [order(k, (TODAY, "10:00:00")) for k in range(300)]
    i = everything(spark, orders)
    store.apply(frame(spark, orders), 0, i, P)
    read, real = [], prefix.partials
    monkeypatch.setattr(prefix, "partials", lambda o, *more: read.append(o) or real(o, *more))
    store.apply(frame(spark, [order(7, (TODAY, "11:00:00")), order(8, (TODAY, "11:00:00"))]), 1, i, P)
    old, everything_of_them = read
    assert sorted(r.order_id for r in old.collect()) == [7, 8]
    assert sorted(r.order_id for r in everything_of_them.collect()) == [7, 7, 8, 8]
    scan = [line for line in old._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]
    assert "bucket" in scan[0].partition("PartitionFilters: ")[2].partition("]")[0]
    # The difference is of the size of the batch.
    assert spark.read.parquet(f"{tmp_path}/sums/run={store._state()['sums'][-1]}").count() <= 4


def test_changed_offers_change_spend(spark, tmp_path):
    orders = drawn(6)
    store = delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS)
    first = everything(spark, orders, OFFERS)
    store.apply(frame(spark, orders[:60]), 0, first, P)
    # One offer more, and one that runs under a template less.
    second = everything(spark, orders, [(1, "T1", TODAY), (2, "T2", LAST_WEEK), (3, "T2", TODAY)])
    store.apply(frame(spark, orders[60:]), 1, second, P)
    assert same(store.report(second, P), compare.hourly_report(second, P))
    assert not same(store.report(second, P), compare.hourly_report(first, P))
    assert len(store._state()["weights"]) == 1


def test_the_slower_of_two_writers_starts_anew(spark, tmp_path, monkeypatch):
    orders = [order(1, (TODAY, "10:00:00"), order_bill=float(k)) for k in range(4)]
    i = everything(spark, orders)
    store, other = (delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS) for _ in range(2))
    real, calls = delta.DeltaStore._difference, []

    def slow(self, *more):
        entry = real(self, *more)
        calls.append(self)
        if self is store and len(calls) == 1:
            other.apply(frame(spark, orders[:2]), 0, i, P)
        return entry

    monkeypatch.setattr(delta.DeltaStore, "_difference", slow)
    assert store.apply(frame(spark, orders[2:]), 1, i, P)
    assert calls == [store, other, store]
    assert same(store.report(i, P), compare.hourly_report(i, P))


def test_a_batch_that_failed_half_way_leaves_no_trace(spark, tmp_path, monkeypatch):
    orders = [order(k, (TODAY, "10:00:00"), order_bill=2.0) for k in range(4)]
    i = everything(spark, orders)
    store = delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS)
    store.apply(frame(spark, orders[:1]), 0, i, P)

    def fail(*more):
        raise OSError("lost")

    monkeypatch.setattr(store.log, "append", fail)
    with pytest.raises(OSError):
        store.apply(frame(spark, orders[1:]), 1, i, P)
    monkeypatch.undo()
    again = delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS)
    assert again.apply(frame(spark, orders[1:]), 1, i, P)
    assert same(again.report(i, P), compare.hourly_report(i, P))
    assert len(again.vacuum()) == 2


def test_days_that_are_compared_no_more_are_left_out(spark, tmp_path):
    old = LAST_WEEK - timedelta(days=1)
    orders = [order(1, (TODAY, "10:00:00")), order(2, (LAST_WEEK, "10:00:00")), order(3, (old, "10:00:00"))]
    i = everything(spark, orders)
    store = delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS)
    store.apply(frame(spark, orders), 0, i, P)
    assert store.rows().count() == 3
    store.compact(P)
    assert store.rows().count() == 2
    store.apply(frame(spark, [order(3, (old, "11:00:00")), order(1, (TODAY, "10:00:00"))]), 1, i, P)
    assert store.sums().where(f"dt = DATE '{old}'").count() == 0
    assert same(store.report(i, P), compare.hourly_report(i, P))


def test_stream(spark, tmp_path):
    folder, work, root = (str(tmp_path / n) for n in ("orders", "work", "stored"))
    orders = drawn(8)
    i = everything(spark, orders)
    for part, p in ((orders[:70], at(11)), (orders[70:], P)):
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        stream = refresh.file_stream(spark, folder, schemas.ORDER_FACTS, "part-*.parquet", files_per_batch=1)
        delta.run_delta(stream, i, work, root, p)
    assert same(snapshot.read_snapshot(spark, root, "hourly").drop("as_of"), compare.hourly_report(i, P))


def test_empty_batch(spark, tmp_path):
    i = everything(spark, [])
    store = delta.DeltaStore(spark, str(tmp_path), schemas.ORDER_FACTS)
    assert store.apply(frame(spark, []), 0, i, P)
    assert same(store.report(i, P), compare.hourly_report(i, P))
