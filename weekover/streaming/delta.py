"""The hourly report maintained by differences.

The store keeps the order rows that have come, in buckets by order, and partial sums by
cluster, day, hour and second (``operators.prefix``). A batch of order rows reads the stored
rows of its own orders only: what those orders gave before goes out of the sums, what they
give with the new rows comes in, and the difference is stored as a run of signed partials.
The report at a clock is read from the sums alone, so neither a batch nor a moving clock
reads the two days again. Late orders, changed and repeated rows are differences like others.

Spend depends on offers, whose look-back moves with the day. The offers' weights that the
sums were made with are stored too. Where a weight has changed, the orders with a line of
that offer are taken out with the former weights and put in with the new ones.

Runs become part of the store by an entry of a numbered log. A batch that was applied is not
applied again, one that failed half way leaves runs that nothing names, and of two writers
the slower one computes its difference anew. City clusters and special coupons are taken to
stay as they are; with others a store is built anew.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekover.operators import prefix, snapshot, spend
from weekover.params import ReportParams
from weekover.sources.files import files
from weekover.sources.inputs import ReportInputs
from weekover.sources.log import Entry, Log, State
from weekover.streaming.refresh import KIND, with_lines

BUCKETS = 64
BUCKET = f"CAST(pmod(xxhash64(order_id), {BUCKETS}) AS int) AS bucket"
PARTIALS = T.StructType(
    [
        T.StructField("cluster", T.StringType()),
        T.StructField("hr", T.IntegerType()),
        *(T.StructField(name, T.IntegerType()) for name in prefix.STEP),
        *(T.StructField(name, T.DecimalType(38, 0) if name in prefix.MONEY else T.LongType()) for name in prefix.MEASURES),
        T.StructField("dt", T.DateType()),
    ]
)
WEIGHTS = T.StructType([T.StructField("offer_id", T.LongType()), T.StructField("templates", T.IntegerType())])


class Overtaken(Exception):
    """Another batch was applied in the meantime."""


def _fold(state: State, entry: Entry) -> State:
    """State: runs of rows, sums and weights, the last batch, a version that batches count, the first day kept."""
    start = {"rows": [], "sums": [], "weights": [], "batch": -1, "version": 0, "floor": "", "dropped": []}
    state = copy.deepcopy(state) or start
    if "batch" in entry:
        state["batch"], state["version"] = entry["batch"], state["version"] + 1
    for name in ("rows", "sums", "weights"):
        replaced = set(entry.get("replaced", {}).get(name, ()))
        state["dropped"] += [f"{name}/{run}" for run in state[name] if run in replaced]
        state[name] = [run for run in state[name] if run not in replaced] + entry.get(name, [])
    state["floor"] = max(state["floor"], entry.get("floor", ""))
    state["dropped"] = [run for run in state["dropped"] if run not in entry.get("removed", ())]
    return state


def _of_orders(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given orders; rows without an id are those of one order."""
    touched = ids.select(F.col("order_id").alias("touched"))
    return rows.join(touched, F.expr("order_id <=> touched"), "left_semi")


def _with_offers(rows: DataFrame, inputs: ReportInputs, offers: DataFrame) -> DataFrame:
    """Orders with a line of one of the offers."""
    if "offer_details" in rows.columns:
        lines = spend.explode_offers(rows, ["order_id"])
    else:
        lines = inputs.offer_lines
    return lines.join(offers, "offer_id", "left_semi").select("order_id").distinct()


def _own_lines(inputs: ReportInputs, rows: DataFrame) -> ReportInputs:
    """The inputs with the lines of the given order rows only, with their day."""
    lines = inputs.offer_lines
    if lines is None:
        return inputs
    placed = rows.select("order_id", "dt").distinct()
    if "dt" in lines.columns:
        return with_lines(inputs, lines.join(placed, ["order_id", "dt"], "left_semi"))
    return with_lines(inputs, lines.join(placed, "order_id"))


class DeltaStore:
    """Maintained sums in a folder; ``schema`` is that of the order rows."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.log = Log(spark, f"{folder}/_log", _fold)

    def _state(self) -> State:
        return self.log.read()[1] or _fold({}, {})

    def _write(self, frame: DataFrame, name: str, *by: str) -> str:
        run = uuid.uuid4().hex
        frame.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{self.folder}/{name}/run={run}")
        return run

    def _read(self, name: str, runs: Sequence[str], schema: T.StructType) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], schema)
        base = f"{self.folder}/{name}"
        found = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/run={run}" for run in runs))
        return found.drop("run")

    def rows(self, runs: Sequence[str] | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Stored order rows; only the folders of the given buckets are read."""
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        found = self._read("rows", self._state()["rows"] if runs is None else runs, schema)
        if buckets is not None:
            found = found.where(F.col("bucket").isin(list(buckets)))
        return found.select(*self.schema.names)

    def sums(self) -> DataFrame:
        """Signed partials of all batches."""
        return self._read("sums", self._state()["sums"], PARTIALS)

    def apply(self, batch: DataFrame, batch_id: int, inputs: ReportInputs, params: ReportParams) -> bool:
        """Add a batch of order rows; false if it was applied before."""
        if batch_id <= self._state()["batch"]:
            return False
        landed = self._write(batch.select(*self.schema.names, F.expr(BUCKET)), "rows", "bucket")
        while (state := self._state())["batch"] < batch_id:
            entry = self._difference(landed, inputs, params, state)

            def decide(present: State) -> Entry:
                if present.get("version", 0) != state["version"]:  # noqa: B023
                    raise Overtaken
                return {**entry, "batch": batch_id}  # noqa: B023

            try:
                self.log.append(decide)
                return True
            except Overtaken:
                continue
        return False

    def _difference(self, landed: str, inputs: ReportInputs, params: ReportParams, state: State) -> Entry:
        """The entry of a batch whose rows are stored: its runs of rows and of signed partials."""
        entry: Entry = {"rows": [landed]}
        before = self._read("weights", state["weights"], WEIGHTS)
        now = spend.offer_weights(inputs.offer_events, inputs.templates, params).select(*WEIGHTS.names)
        other = now.withColumnRenamed("templates", "new").join(before, "offer_id", "full_outer")
        changed = other.where("NOT (templates <=> new)").select("offer_id")
        reweighed = not changed.isEmpty()
        if reweighed:
            entry |= {"weights": [self._write(now, "weights")], "replaced": {"weights": state["weights"]}}
            now = self._read("weights", entry["weights"], WEIGHTS)
        else:
            # The same weights, so that what is made with them before and now is one plan.
            now = before
        new = self.rows([landed])
        if state["floor"]:
            new = new.where(f"dt >= DATE '{state['floor']}'")
        ids = new.select("order_id").distinct()
        # One row per bucket at most.
        buckets = [row[0] for row in ids.selectExpr(BUCKET).distinct().collect()]
        if reweighed and state["rows"]:
            held = self.rows(state["rows"])
            ids = ids.union(_with_offers(held, inputs, changed)).distinct()
            buckets = None
        old = _of_orders(self.rows(state["rows"], buckets), ids)
        all_rows = old.unionByName(new)
        # Lines of new rows' orders only are harmless to the stored ones: rows meet their own lines.
        own = _own_lines(inputs, all_rows)
        changes = []
        if state["rows"]:
            changes.append(prefix.negated(prefix.partials(old, own, params, before)))
        changes.append(prefix.partials(all_rows, own, params, now))
        entry["sums"] = [self._write(prefix.summed(reduce(DataFrame.unionByName, changes)), "sums", "dt")]
        return entry

    def report(self, inputs: ReportInputs, params: ReportParams) -> DataFrame:
        """The hourly report at the clock; of ``inputs`` only traffic and dimensions are read."""
        return prefix.report_at(prefix.sums_at(self.sums(), params), inputs, params)

    def compact(self, params: ReportParams) -> bool:
        """Merge the runs into one each, without the days before those that ``params`` compares.

        Later batches leave out rows of such days. False if another compaction was faster.
        """
        state = self._state()
        kept = F.col("dt") >= F.lit(params.last_week)
        entry = {
            "replaced": {name: state[name] for name in ("rows", "sums")},
            "rows": [self._write(self.rows(state["rows"]).where(kept).select("*", F.expr(BUCKET)), "rows", "bucket")],
            "sums": [self._write(prefix.summed(self._read("sums", state["sums"], PARTIALS).where(kept)), "sums", "dt")],
            "floor": str(params.last_week),
        }

        def decide(present: State) -> Entry | None:
            there = all(set(state[name]) <= set(present.get(name, ())) for name in ("rows", "sums"))
            return entry if there else None

        return self.log.append(decide) is not None

    def vacuum(self) -> list[str]:
        """Remove runs that the store does not name, while nothing reads or writes it."""
        state = self._state()
        gone = []
        for name in ("rows", "sums", "weights"):
            folder = files(self.spark, f"{self.folder}/{name}")
            for run in folder.names():
                if run.removeprefix("run=") not in state[name]:
                    folder.remove(run)
                    gone.append(f"{name}/{run}")
        if state["dropped"]:
            self.log.append(lambda present: {"removed": state["dropped"]})
        self.log.prune()
        return gone


def run_delta(
    orders: DataFrame, inputs: ReportInputs, work_folder: str, snapshot_root: str, params: ReportParams
) -> None:
    """Use up a stream of order rows, then store the report at the clock of ``params``."""
    spark = orders.sparkSession
    store = DeltaStore(spark, f"{work_folder}/store", orders.schema)

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id, inputs, params)

    (
        orders.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{work_folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    snapshot.write_snapshot(store.report(inputs, params), snapshot_root, KIND, params)
