"""Offers within a sliding look-back, kept up to date by one day's events at a time.

A table holds the last day each pair of offer and listed template was seen. A pair is within
the look-back of a day if that last day is, so the window is a comparison: a day adds its own
events, and pairs expire without any of the former events being read again. Pairs whose last
day is before the look-back are left out when the table is written anew, which bounds it.

Each day's table is a run of its own that a log entry names; a day that was added before is
left as it is. The pairs can be asked for on the last added day only: an earlier one would
need to know what a pair's last day was then.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekover.operators import spend
from weekover.params import ReportParams
from weekover.sources.files import files
from weekover.sources.log import Entry, Log, State

SCHEMA = "offer_id bigint, template_id string, last_day date"


def _fold(state: State, entry: Entry) -> State:
    return {"day": entry["day"], "run": entry["run"], "former": state.get("run")}


class SlidingOffers:
    """The maintained table in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.log = Log(spark, f"{folder}/_log", _fold)

    def _table(self, state: State) -> DataFrame:
        if not state:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/runs/{state['run']}")

    def start(self, offer_events: DataFrame, templates: DataFrame, params: ReportParams) -> None:
        """Fill the table with the whole look-back of the day of ``params``."""
        self._add(spend.listed_events(offer_events, templates, params, ("dt",)), params)

    def add_day(self, offer_events: DataFrame, templates: DataFrame, params: ReportParams) -> None:
        """Add the events of the day of ``params``, which follows the last added one; no other day is read."""
        events = offer_events.where(F.col("dt") == F.lit(params.today))
        self._add(spend.listed_events(events, templates, params, ("dt",)), params, follows=True)

    def _add(self, events: DataFrame, params: ReportParams, follows: bool = False) -> None:
        number, state = self.log.read()
        if state and date.fromisoformat(state["day"]) >= params.today:
            return
        if follows and (not state or date.fromisoformat(state["day"]) != params.today - timedelta(days=1)):
            raise ValueError(f"the day before {params.today} has not been added")
        pairs = self._table(state).unionByName(events.withColumnRenamed("dt", "last_day"))
        table = pairs.groupBy("offer_id", "template_id").agg(F.max("last_day").alias("last_day"))
        run = uuid.uuid4().hex
        table.where(F.col("last_day") >= F.lit(params.lookback_start)).write.parquet(f"{self.folder}/runs/{run}")

        def decide(present: State) -> Entry | None:
            # Another writer may have added the day in the meantime, with the same events.
            return {"day": str(params.today), "run": run} if present == state else None

        self.log.append(decide)

    def targeted(self, params: ReportParams) -> DataFrame:
        """Distinct (offer, template) pairs within the look-back, as ``spend.targeted_offers`` gives them."""
        _, state = self.log.read()
        if not state or date.fromisoformat(state["day"]) != params.today:
            raise LookupError(f"the last added day is {state.get('day')}, not {params.today}")
        within = F.col("last_day").between(F.lit(params.lookback_start), F.lit(params.today))
        return self._table(state).where(within).select("offer_id", "template_id")

    def vacuum(self) -> None:
        """Remove the tables of days before the last two."""
        _, state = self.log.read()
        runs = files(self.spark, f"{self.folder}/runs")
        for run in runs.names():
            if state and run not in (state["run"], state["former"]):
                runs.remove(run)
        self.log.prune()
