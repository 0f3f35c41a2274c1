"""Metrics as data: one list per report drives its columns, deltas, pivots and tags."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class HourlyMetric:
    """One metric of the hourly report.

    ``change_kind`` is ``growth`` (percent of last week) or ``point`` (difference).
    ``rate`` marks per-order rates, which the total row recombines weighted by orders.
    """

    name: str
    tw: str
    lw: str
    change: str
    change_kind: str
    digits: int
    section: str
    rate: bool = True
    inverted: bool = False

    @property
    def change_digits(self) -> int:
        return 1 if self.change_kind == "growth" else max(self.digits, 1)


HOURLY_METRICS = (
    HourlyMetric("orders", "total_opd", "lw_opd", "opd_gr", "growth", 0, "demand", rate=False),
    HourlyMetric("sessions", "sessions", "lw_sessions", "traffic_gr", "growth", 0, "demand", rate=False),
    HourlyMetric("cvr", "cvr", "lw_cvr", "cvr_chg", "point", 2, "demand", rate=False),
    HourlyMetric("ob", "ob_pct", "lw_ob_pct", "ob_chg", "point", 1, "demand", inverted=True),
    HourlyMetric("amv", "amv", "lw_amv", "amv_gr", "growth", 0, "demand"),
    HourlyMetric("cdpo", "cdpo_po", "lw_cdpo", "cdpo_chg", "point", 2, "cost"),
    HourlyMetric("sdpo", "sdpo_po", "lw_sdpo", "sdpo_chg", "point", 2, "cost"),
    HourlyMetric("rdpo", "rdpo_po", "lw_rdpo", "rdpo_chg", "point", 2, "cost"),
    HourlyMetric("targeted", "targeted_po", "lw_targeted", "targeted_chg", "point", 2, "cost"),
    HourlyMetric("special", "special_po", "lw_special", "special_chg", "point", 2, "cost"),
    HourlyMetric("residual", "residual", "lw_residual", "residual_chg", "point", 2, "cost"),
)

RATE_METRICS = tuple(m for m in HOURLY_METRICS if m.rate)


def hourly_columns() -> list[str]:
    """Report columns in output order: the hour, then the triple of every metric."""
    return ["hr"] + [c for m in HOURLY_METRICS for c in (m.tw, m.lw, m.change)]


# Sums carried by the city and state facts.
COUNT_MEASURES = ("orders", "coupon_orders")
MONEY_MEASURES = (
    "cdpo_sum",
    "sdpo_sum",
    "rdpo_sum",
    "platform_sum",
    "campaign_sum",
    "targeted_sum",
    "special_sum",
)
TRAFFIC_MEASURES = ("sessions", "lw_sessions", "conv_sessions", "lw_conv_sessions")
GROUP_MEASURES = COUNT_MEASURES + MONEY_MEASURES + TRAFFIC_MEASURES

# Metrics of the city and state reports, in display order.
GROUP_METRICS = (
    "orders",
    "sessions",
    "cvr",
    "oc_pct",
    "cdpo",
    "rdpo",
    "sdpo",
    "residual",
    "special",
    "targeted",
    "campaign",
)

# Sums that each of them is derived from.
METRIC_SUMS = {
    "orders": ("orders",),
    "sessions": ("sessions", "lw_sessions"),
    "cvr": TRAFFIC_MEASURES,
    "oc_pct": ("orders", "coupon_orders"),
    "cdpo": ("orders", "cdpo_sum"),
    "rdpo": ("orders", "rdpo_sum"),
    "sdpo": ("orders", "sdpo_sum"),
    "residual": ("orders", "platform_sum", "special_sum"),
    "special": ("orders", "special_sum"),
    "targeted": ("orders", "targeted_sum"),
    "campaign": ("orders", "campaign_sum"),
}
GROWTH_METRICS = frozenset({"orders", "sessions"})
INVERTED_METRICS = frozenset({"oc_pct"})
