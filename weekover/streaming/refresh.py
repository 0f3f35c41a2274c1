"""Incremental refresh: each micro-batch of order rows updates the stored hourly report.

Exact distinct counts and a cutoff that moves with the latest order rule out an append or
update aggregate over the stream. Every batch therefore lands all its rows, by day, whatever
the clock says; day and clock are applied when the landed rows are read, so what is too
early for one run is there for the next, and for next week's comparison. Only the two
compared days are read, and only the clusters that a batch touches are recomputed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekover.operators import compare, filters, snapshot
from weekover.params import ReportParams
from weekover.sources.inputs import FrameInputs, ReportInputs

KIND = "hourly"


def file_stream(
    spark: SparkSession, folder: str, schema, pattern: str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def land(batch: DataFrame, batch_id: int, landing: str) -> None:
    """Store a batch under its own number, so that a repeated batch replaces its rows.

    One file per day and batch, or more where a day is large.
    """
    (
        batch.hint("rebalance", "dt")
        .write.mode("overwrite")
        .partitionBy("dt")
        .parquet(f"{landing}/batch_id={batch_id}")
    )


def landed_orders(spark: SparkSession, landing: str, schema, params: ReportParams) -> DataFrame:
    """Landed rows of the two compared days; files of other days are not read."""
    rows = spark.read.schema(schema).parquet(landing)
    return rows.where(F.col("dt").isin(params.today, params.last_week)).drop("batch_id")


def compact(spark: SparkSession, landing: str, target: str, schema) -> None:
    """Rewrite all landed rows into few files per day at ``target``, while no stream runs.

    A later run lands in ``target``; the batches of one checkpoint go on counting, so their
    numbers stay apart from the compacted one.
    """
    rows = spark.read.schema(schema).parquet(landing).drop("batch_id")
    land(rows, -1, target)


def with_lines(inputs: ReportInputs, lines: DataFrame) -> FrameInputs:
    """The same inputs with other offer lines."""
    frames = {name: getattr(inputs, name) for name in FrameInputs.__dataclass_fields__}
    return FrameInputs(**{**frames, "offer_lines": lines})


def refreshed(inputs: ReportInputs, orders: DataFrame, params: ReportParams) -> DataFrame:
    """The hourly report over the given orders, with everything else from ``inputs``."""
    frames = {name: getattr(inputs, name) for name in FrameInputs.__dataclass_fields__ if name != "orders"}
    return compare.hourly_report(FrameInputs(orders=orders, **frames), params)


def touched_clusters(orders: DataFrame, cluster_dim: DataFrame, params: ReportParams) -> list[str]:
    """Clusters with rows in the compared days, found by city; there are few clusters."""
    cities = orders.where(F.col("dt").isin(params.today, params.last_week)).select("city_code").distinct()
    found = filters.in_clusters(cities, cluster_dim, params).select("cluster").distinct().collect()
    return sorted(row["cluster"] for row in found)


def start_refresh(
    orders: DataFrame, inputs: ReportInputs, work_folder: str, snapshot_root: str, params: ReportParams
) -> StreamingQuery:
    """Run a stream of canonical order rows until its present input is used up."""
    landing, schema = f"{work_folder}/landing", orders.schema

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        land(batch, batch_id, landing)
        own = spark.read.schema(schema).parquet(f"{landing}/batch_id={batch_id}")
        touched = touched_clusters(own, inputs.cluster_dim, params)
        if touched:
            part = replace(params, clusters=tuple(touched))
            report = refreshed(inputs, landed_orders(spark, landing, schema, part), part)
            snapshot.write_snapshot(report, snapshot_root, KIND, part)

    return (
        orders.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", f"{work_folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def run_refresh(
    orders: DataFrame, inputs: ReportInputs, work_folder: str, snapshot_root: str, params: ReportParams
) -> None:
    """Use up the stream, then bring stored clusters of an earlier clock up to this one.

    The clock alone can change a report: rows that landed early become known.
    """
    start_refresh(orders, inputs, work_folder, snapshot_root, params).awaitTermination()
    spark = orders.sparkSession
    stale = {p.cluster for p in snapshot.latest_runs(spark, snapshot_root, KIND) if p.as_of < params.as_of_text}
    clusters = tuple(sorted(stale & set(params.clusters)))
    if clusters:
        part = replace(params, clusters=clusters)
        landed = landed_orders(spark, f"{work_folder}/landing", orders.schema, part)
        snapshot.write_snapshot(refreshed(inputs, landed, part), snapshot_root, KIND, part)
