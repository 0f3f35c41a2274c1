"""The hourly this-week versus last-week report and its weighted total row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekover.functions.labels import daypart
from weekover.functions.numeric import aliased, change, growth_pct, percent, ratio, rounded
from weekover.metrics import RATE_METRICS, TRAFFIC_MEASURES, hourly_columns
from weekover.operators import facts, filters, traffic
from weekover.params import ReportParams
from weekover.sources.inputs import ReportInputs

TOTAL = "Overall"
COUNTS = ("total_opd", "lw_opd", *TRAFFIC_MEASURES)


def paired_rates(kpis: DataFrame, by_hour: DataFrame) -> DataFrame:
    """Rounded rates of today and last week with the traffic of the hour, one row per hour.

    ``kpis`` has both days of an hour side by side.
    """
    columns = {"total_opd": "tw_total_opd", "lw_opd": "lw_total_opd"}
    for m in RATE_METRICS:
        for side, name in (("tw", m.tw), ("lw", m.lw)):
            if m.name == "residual":
                columns[name] = rounded(f"{side}_total_platform_po - {side}_special_po", 2)
            else:
                columns[name] = f"{side}_{m.tw}"
    return kpis.join(by_hour, ["cluster", "hr"], "left").selectExpr(
        "cluster", "hr", *aliased(columns), *TRAFFIC_MEASURES
    )


def weights() -> dict[str, str]:
    """What an hour adds to a total: its counts, and its rates times the orders of their day."""
    parts = {name: name for name in COUNTS}
    for m in RATE_METRICS:
        parts[m.tw] = f"cast({m.tw} AS decimal(18,2)) * total_opd"
        parts[m.lw] = f"cast({m.lw} AS decimal(18,2)) * lw_opd"
    return parts


def report_columns() -> dict[str, str]:
    """Every metric with last week and change, from counts and order-weighted rates."""
    cvr, lw_cvr = percent("conv_sessions", "sessions"), percent("lw_conv_sessions", "lw_sessions")
    columns = {
        "total_opd": "total_opd",
        "lw_opd": "lw_opd",
        "opd_gr": rounded(growth_pct("total_opd", "lw_opd"), 1),
        "sessions": "sessions",
        "lw_sessions": "lw_sessions",
        "traffic_gr": rounded(growth_pct("sessions", "lw_sessions"), 1),
        "cvr": rounded(cvr, 2),
        "lw_cvr": rounded(lw_cvr, 2),
        "cvr_chg": rounded(f"{cvr} - {lw_cvr}", 2),
    }
    for m in RATE_METRICS:
        tw, lw = ratio(m.tw, "total_opd"), ratio(m.lw, "lw_opd")
        columns |= {
            m.tw: rounded(tw, m.digits),
            m.lw: rounded(lw, m.digits),
            m.change: change(tw, lw, m.change_kind, m.change_digits),
        }
    return columns


def hourly_wow(rates: DataFrame) -> DataFrame:
    """One row per hour of today: every metric with last week and change."""
    parts = rates.selectExpr("cluster", "hr", *aliased(weights()))
    return parts.selectExpr("cluster", "cast(hr AS string) AS hr", *aliased(report_columns()))


def with_total(rates: DataFrame, clusters: DataFrame) -> DataFrame:
    """Hour rows and the total of every cluster, in one rollup.

    The total sums the counts and recombines the rounded hourly rates weighted by orders,
    its changes coming from the unrounded values; the weighted rate of a single hour is
    the rate itself. Blank rows, one per entry of ``clusters``, make sure that a cluster
    without hours gets its total, of NULLs. ``pos`` sorts the total last.
    """
    blank = clusters.selectExpr("cluster", "FALSE AS is_hour")
    rows = rates.selectExpr("*", "TRUE AS is_hour").unionByName(blank, allowMissingColumns=True)
    sums = {name: f"sum({part})" for name, part in weights().items()}
    sums |= {"is_total": "grouping(hr) = 1", "is_hour": "max(is_hour)"}
    rolled = rows.groupingSets([["cluster", "hr"], ["cluster"]], "cluster", "hr").agg(*map(F.expr, aliased(sums)))
    label = f"if(is_total, '{TOTAL}', cast(hr AS string)) AS hr"
    position = "if(is_total, 999, hr) AS pos"
    return (
        rolled.where("is_total OR is_hour")
        .selectExpr("cluster", label, *aliased(report_columns()), position)
        .select("cluster", *hourly_columns(), "pos")
    )


def with_traffic(kpis: DataFrame, inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """``paired_rates`` with the traffic of the inputs."""
    by_hour = traffic.traffic_by_hour(
        traffic.cluster_traffic(inputs.traffic, inputs.cluster_classes, params)
    )
    return paired_rates(kpis, by_hour)


def hourly_rates(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    return with_traffic(facts.paired_kpis(facts.hourly_orders(inputs, params), params), inputs, params)


def hourly_rows(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The hour rows of the report without its totals."""
    return hourly_wow(hourly_rates(inputs, params))


def hourly_report(inputs: ReportInputs, params: ReportParams) -> DataFrame:
    """The complete hourly report of every cluster with cities in the cluster dimension."""
    return with_total(hourly_rates(inputs, params), filters.cluster_cities(inputs.cluster_dim, params))


def report_meta(report: DataFrame, params: ReportParams) -> DataFrame:
    """Generation stamp, latest hour (0 when empty) and row split of a report."""
    is_total = f"hr <=> '{TOTAL}'"
    columns = {
        "as_of": f"'{params.as_of_text}'",
        "latest_hr": f"coalesce(max(if({is_total}, NULL, cast(nullif(hr, '{TOTAL}') AS int))), 0)",
        "detail_rows": f"count_if(NOT {is_total})",
        "has_total": f"max({is_total})",
    }
    return report.groupBy("cluster").agg(*map(F.expr, aliased(columns)))


def mark_partial_hour(wow: DataFrame) -> DataFrame:
    """Flags the latest hour of each cluster, which is still filling."""
    # A cluster has one row per hour of the day.
    return wow.selectExpr(
        "cluster", "hr", "cast(hr AS int) = max(cast(hr AS int)) OVER (PARTITION BY cluster) AS is_partial"
    )


def daypart_rollup(kpis: DataFrame) -> DataFrame:
    return (
        kpis.selectExpr("cluster", f"{daypart('hr')} AS daypart", "dt", "total_opd")
        .groupBy("cluster", "daypart", "dt")
        .agg(F.expr("sum(total_opd) AS total_opd"))
    )
