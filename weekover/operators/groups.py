"""City and state reports: sums by group and hour, per-order ratios, summary, dense grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.numeric import aliased, growth_pct, percent, ratio, rounded
from weekover.metrics import GROUP_MEASURES, GROUP_METRICS, GROWTH_METRICS, METRIC_SUMS
from weekover.params import ReportParams

UNKNOWN_GROUP = "Unknown"
UNKNOWN_HOUR = -1


def group_hour_sums(facts: DataFrame) -> DataFrame:
    """Facts with a name for unknown groups and hours, missing measures as zero."""
    return (
        facts.selectExpr(
            "* EXCEPT (grp, hr)",
            f"coalesce(nullif(grp, ''), '{UNKNOWN_GROUP}') AS grp",
            f"coalesce(hr, {UNKNOWN_HOUR}) AS hr",
        )
        .groupBy("cluster", "grp", "hr", "dt")
        .agg(*[F.expr(f"sum(coalesce({m}, 0)) AS {m}") for m in GROUP_MEASURES])
    )


def placed(facts: DataFrame) -> DataFrame:
    """Facts with ``pos``, their place by day, group and hour within the cluster.

    A cluster has one row per group of the city dimension, hour and day.
    """
    return facts.selectExpr(
        "*", "cast(row_number() OVER (PARTITION BY cluster ORDER BY dt, grp, hr) AS int) AS pos"
    )


def group_keys(sums: DataFrame) -> DataFrame:
    """Groups seen on either day."""
    return sums.select("cluster", "grp").distinct()


def traffic_pack(prefix: str) -> dict[str, str]:
    sessions = f"{prefix}sessions"
    return {
        "sessions": f"cast({sessions} AS bigint)",
        "cvr": rounded(percent(f"{prefix}conv_sessions", sessions), 2),
    }


def ratio_pack(prefix: str = "") -> dict[str, str]:
    """Metrics of one side from its sums, whose columns start with ``prefix``."""
    orders = f"{prefix}orders"
    totals = {
        "cdpo": f"{prefix}cdpo_sum",
        "sdpo": f"{prefix}sdpo_sum",
        "rdpo": f"{prefix}rdpo_sum",
        "residual": f"({prefix}platform_sum - {prefix}special_sum)",
        "special": f"{prefix}special_sum",
        "targeted": f"{prefix}targeted_sum",
        "campaign": f"{prefix}campaign_sum",
    }
    return {
        "orders": f"cast({orders} AS bigint)",
        "oc_pct": rounded(percent(f"{prefix}coupon_orders", orders), 1),
        **{name: rounded(ratio(total, orders), 2) for name, total in totals.items()},
        **traffic_pack(prefix),
    }


def group_ratios(sums: DataFrame) -> DataFrame:
    """The ratio pack of every stored row, with last week's traffic beside it."""
    last_week = {f"lw_{name}": column for name, column in traffic_pack("lw_").items()}
    return sums.selectExpr("cluster", "grp", "hr", "dt", *aliased(ratio_pack() | last_week))


def _sides(metrics: Sequence[str] = GROUP_METRICS) -> list[str]:
    """``tw_*`` and ``lw_*`` metrics; last week's traffic is read from today's rows."""
    packs = {"tw": ratio_pack("tw_"), "lw": ratio_pack("lw_") | traffic_pack("tw_lw_")}
    return aliased({f"{side}_{name}": packs[side][name] for side in packs for name in metrics})


def _days(params: ReportParams) -> dict[str, str]:
    return {"tw": f"dt = DATE '{params.today}'", "lw": f"dt = DATE '{params.last_week}'"}


def _summary_change(name: str) -> str:
    tw, lw = f"tw_{name}", f"lw_{name}"
    return rounded(growth_pct(tw, lw), 1) if name in GROWTH_METRICS else rounded(f"{tw} - {lw}", 2)


def group_summary(sums: DataFrame, params: ReportParams) -> DataFrame:
    """One row per group over all hours, the unknown one included."""
    both = {
        f"{side}_{m}": f"coalesce(sum({m}) FILTER (WHERE {day}), 0)"
        for side, day in _days(params).items()
        for m in GROUP_MEASURES
    }
    sides = (
        sums.groupBy("cluster", "grp")
        .agg(*map(F.expr, aliased(both)))
        .selectExpr("cluster", "grp", *_sides())
    )
    return sides.selectExpr("*", *aliased({f"d_{name}": _summary_change(name) for name in GROUP_METRICS}))


def group_hour_grid(sums: DataFrame, params: ReportParams, metrics: Sequence[str] = GROUP_METRICS) -> DataFrame:
    """Every group with every hour seen in its cluster, empty cells as zero.

    The unknown hour is left out. A group's cells, 25 a day at most, are kept in two maps
    by hour, and the hours it saw as bits; the bits of all groups of a cluster, of which
    there are as many as in the city dimension, say which hours each group unfolds to.
    So the facts are read once, and groups and hours are never crossed by a join.
    """
    measures = [m for m in GROUP_MEASURES if any(m in METRIC_SUMS[name] for name in metrics)]
    cell = f"struct({', '.join(measures)})"
    known = f"hr != {UNKNOWN_HOUR}"
    per_group = {
        f"{side}_cells": f"map_from_entries(collect_list(struct(hr, {cell})) FILTER (WHERE {known} AND {day}))"
        for side, day in _days(params).items()
    }
    per_group["own_hours"] = f"coalesce(bit_or(shiftleft(1, hr)) FILTER (WHERE {known}), 0)"
    seen = "bit_or(own_hours) OVER (PARTITION BY cluster)"
    return (
        sums.groupBy("cluster", "grp")
        .agg(*map(F.expr, aliased(per_group)))
        .selectExpr("*", f"{seen} AS seen")
        .selectExpr("*", "explode(filter(sequence(0, 23), h -> getbit(seen, h) = 1)) AS hr")
        .selectExpr(
            "cluster", "grp", "hr", *[f"coalesce({s}_cells[hr].{m}, 0) AS {s}_{m}" for s in ("tw", "lw") for m in measures]
        )
        .selectExpr("cluster", "grp", "hr", *_sides(metrics))
    )


def nested_hourly(grid: DataFrame) -> DataFrame:
    """One row per group with its hours as an ordered array, 24 entries at most."""

    def side(prefix: str) -> str:
        fields = ", ".join(f"'{name}', {prefix}_{name}" for name in GROUP_METRICS)
        return f"'{prefix}', named_struct({fields})"

    cell = f"named_struct('hr', hr, {side('tw')}, {side('lw')})"
    return grid.groupBy("cluster", "grp").agg(F.expr(f"array_sort(collect_list({cell})) AS hours"))


def hour_reagg(grid: DataFrame, hours: Sequence[int]) -> DataFrame:
    """Orders, sessions and conversion of each group over the chosen hours.

    Conversion is the session-weighted mean of the rounded hourly values; a zero
    conversion is reported as missing. Other metrics cannot be recombined.
    """
    sums = {f"{side}_{m}": f"sum({side}_{m})" for side in ("tw", "lw") for m in ("orders", "sessions")}
    for side in ("tw", "lw"):
        weighted = f"sum(cast(coalesce({side}_cvr, 0) AS decimal(18,2)) * {side}_sessions)"
        sums[f"{side}_mean"] = f"nullif({ratio(weighted, f'sum({side}_sessions)')}, 0)"
    picked = grid.where(F.col("hr").isin(list(hours)))
    columns = {}
    for m in ("orders", "sessions"):
        tw, lw = f"tw_{m}", f"lw_{m}"
        columns |= {tw: tw, lw: lw, f"d_{m}": rounded(growth_pct(tw, lw), 2)}
    columns |= {
        "tw_cvr": rounded("tw_mean", 2),
        "lw_cvr": rounded("lw_mean", 2),
        "d_cvr": rounded("tw_mean - lw_mean", 2),
    }
    return (
        picked.groupBy("cluster", "grp")
        .agg(*map(F.expr, aliased(sums)))
        .selectExpr("cluster", "grp", *aliased(columns))
    )
