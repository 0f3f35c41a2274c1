"""Presentation shapes of a report: pivots, lists, sort positions, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.labels import DEAD_BAND, direction
from weekover.functions.numeric import aliased, growth_pct, rounded
from weekover.metrics import GROWTH_METRICS, HOURLY_METRICS, INVERTED_METRICS
from weekover.operators.compare import TOTAL

HOURS = tuple(range(24))

# Fixed value: a cell is tagged from one part in so many of the average on.
HEAT_BAND_PARTS = 20


def metric_rows(report: DataFrame) -> DataFrame:
    """A report unfolded to one row per row and metric: value, last week, change."""
    entries = ", ".join(
        f"named_struct('section', '{m.section}', 'metric', '{m.name}', 'inverted', {m.inverted}, "
        f"'value', cast({m.tw} AS double), 'lw', cast({m.lw} AS double), 'change', cast({m.change} AS double))"
        for m in HOURLY_METRICS
    )
    return report.selectExpr("cluster", "hr", f"inline(array({entries}))")


def metric_hour_matrix(report: DataFrame) -> DataFrame:
    """Metric and side (tw, lw, delta) by hour; absent hours stay blank."""
    names = {TOTAL: "overall"} | {str(h): f"h{h}" for h in HOURS}
    matrix = (
        metric_rows(report)
        .selectExpr("cluster", "hr", "metric", "stack(3, 'tw', value, 'lw', lw, 'delta', change) AS (side, cell)")
        .groupBy("cluster", "metric", "side")
        .pivot("hr", list(names))
        .agg(F.first("cell"))
    )
    return matrix.selectExpr("cluster", "metric", "side", *aliased({v: f"`{k}`" for k, v in names.items()}))


def kpi_list(report: DataFrame) -> DataFrame:
    """The total row as a list of metrics with their direction of change."""
    return metric_rows(report.where(F.col("hr") == TOTAL)).selectExpr(
        "cluster", "section", "metric", "value", "lw", "change", f"{direction('change', 'inverted')} AS direction"
    )


def change_direction(wow: DataFrame) -> DataFrame:
    """Direction of every change, plain and with the dead band."""
    return metric_rows(wow).selectExpr(
        "cluster",
        "hr",
        "metric",
        "change",
        f"{direction('change', 'inverted')} AS direction",
        f"{direction('change', 'inverted', DEAD_BAND)} AS direction_band",
    )


def cell_change(metric: str) -> str:
    """Change of one grid cell: growth if the metric has it and last week is not zero."""
    tw, lw = f"tw_{metric}", f"lw_{metric}"
    difference = rounded(f"{tw} - {lw}", 2)
    if metric not in GROWTH_METRICS:
        return difference
    return f"if({lw} != 0, {rounded(growth_pct(tw, lw), 2)}, {difference})"


def pivot_metric(grid: DataFrame, metric: str) -> DataFrame:
    """One metric by group, with today, last week and change for each of the 24 hours."""
    cells = grid.selectExpr(
        "cluster",
        "grp",
        "hr",
        f"cast(tw_{metric} AS double) AS tw",
        f"cast(lw_{metric} AS double) AS lw",
        f"{cell_change(metric)} AS d",
    )
    wide = (
        cells.groupBy("cluster", "grp")
        .pivot("hr", list(HOURS))
        .agg(*[F.first(c).alias(c) for c in ("tw", "lw", "d")])
    )
    return wide.selectExpr("cluster", "grp", *[f"{h}_{c} AS h{h}_{c}" for h in HOURS for c in ("tw", "lw", "d")])


def heat_tag(grid: DataFrame, metric: str) -> DataFrame:
    """Today's cells against the group's own average over its positive hours.

    Cells within the band of the average stay blank, a zero cell counts as below. The
    comparison is scaled to whole decimals, so the edge of the band is exact.
    """
    # A group has 24 rows at most.
    own = "OVER (PARTITION BY cluster, grp)"
    above, below = ("bad", "good") if metric in INVERTED_METRICS else ("good", "bad")
    return (
        grid.selectExpr("cluster", "grp", "hr", f"cast(tw_{metric} AS decimal(18,2)) AS cell")
        .selectExpr(
            "*",
            f"sum(if(cell > 0, cell, NULL)) {own} AS total",
            f"cell * count(if(cell > 0, 1, NULL)) {own} AS scaled",
        )
        .selectExpr(
            "cluster",
            "grp",
            "hr",
            "cast(cell AS double) AS value",
            f"""CASE WHEN scaled IS NULL OR total IS NULL OR abs(scaled - total) * {HEAT_BAND_PARTS} < total THEN ''
                WHEN scaled > total THEN '{above}' ELSE '{below}' END AS tag""",
        )
    )


def group_rank(summary: DataFrame) -> DataFrame:
    """Groups by today's orders, largest first, names breaking ties.

    A cluster has one summary row per group of the city dimension.
    """
    position = "row_number() OVER (PARTITION BY cluster ORDER BY tw_orders DESC, grp) AS pos"
    return summary.selectExpr("cluster", "grp", "tw_orders AS orders", position)


def sort_nulls_last(summary: DataFrame, column: str) -> DataFrame:
    """Positions of the groups sorted by one column; NULLs come last both ways."""

    def position(order: str) -> str:
        return f"row_number() OVER (PARTITION BY cluster ORDER BY {column} {order} NULLS LAST, grp)"

    return summary.selectExpr(
        "cluster",
        "grp",
        f"cast({column} AS double) AS value",
        f"{position('ASC')} AS pos_asc",
        f"{position('DESC')} AS pos_desc",
    )
