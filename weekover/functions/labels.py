"""Tags and bins computed from one row, as SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from weekover.params import LABEL_GAPS

# First hour after each daypart, and its name.
DAYPARTS = ((6, "late_night"), (12, "morning"), (15, "lunch"), (18, "afternoon"), (24, "dinner"))

# A change smaller than this is shown as none.
DEAD_BAND = 0.005

# Orders per hour above which a city is critical or in warning.
CRITICAL_ORDERS = 5000
WARNING_ORDERS = 3000

# Minutes of delay for a delayed order and for the two severities.
DELAYED_MINUTES = 10
HIGH_DELAY_MINUTES = 12
MEDIUM_DELAY_MINUTES = 8

COUPON_PRESENT = "(coupon_code IS NOT NULL AND coupon_code != '')"


def daypart(hour: str) -> str:
    bins = " ".join(f"WHEN {hour} < {upper} THEN '{name}'" for upper, name in DAYPARTS)
    return f"CASE {bins} END"


def cluster_slug(label: str, known: Sequence[str], default: str) -> str:
    """Normalised cluster name; labels of no known cluster give the default one."""
    slug = f"translate(lower({label}), '{LABEL_GAPS}', '{'_' * len(LABEL_GAPS)}')"
    names = ", ".join(f"'{name}'" for name in known)
    return f"if({slug} IN ({names}), {slug}, '{default}')"


def direction(value: str, inverted: str = "FALSE", band: float = 0.0) -> str:
    """``pos``, ``neg``, ``neu`` or ``na``; for inverted metrics a fall is good."""
    neutral = f"abs({value}) < {band}D" if band else f"{value} = 0"
    good = f"if({inverted}, {value} < 0, {value} > 0)"
    return (
        f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 'na' WHEN {neutral} THEN 'neu' "
        f"WHEN {good} THEN 'pos' ELSE 'neg' END"
    )


def status_tier(orders: str, critical: int = CRITICAL_ORDERS, warning: int = WARNING_ORDERS) -> str:
    return f"CASE WHEN {orders} > {critical} THEN 'CRITICAL' WHEN {orders} > {warning} THEN 'WARNING' ELSE 'NORMAL' END"


def delay_severity(minutes: str) -> str:
    return f"CASE WHEN {minutes} > {HIGH_DELAY_MINUTES} THEN 'high' WHEN {minutes} > {MEDIUM_DELAY_MINUTES} THEN 'medium' END"
