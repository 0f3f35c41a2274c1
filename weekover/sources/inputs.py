"""The frames one report run reads."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame


class ReportInputs(Protocol):
    """Canonical frames, see ``schemas``.

    Rows of ``special_coupons``, ``cluster_dim`` and ``cluster_classes`` are unique; a
    city or a template may repeat, with the effect the report operators describe.

    Offers come in one of two storage forms: nested, as the array ``offer_details`` on
    each order row (``offer_lines`` is then None), or normalised, as one ``offer_lines``
    row per order and offer, with the order's day ``dt`` if they are stored by day.
    """

    orders: DataFrame
    offer_lines: DataFrame | None
    offer_events: DataFrame
    templates: DataFrame
    special_coupons: DataFrame
    city_dim: DataFrame
    cluster_dim: DataFrame
    cluster_classes: DataFrame
    traffic: DataFrame


@dataclass(frozen=True)
class FrameInputs:
    """Inputs given as frames."""

    orders: DataFrame
    offer_lines: DataFrame | None
    offer_events: DataFrame
    templates: DataFrame
    special_coupons: DataFrame
    city_dim: DataFrame
    cluster_dim: DataFrame
    cluster_classes: DataFrame
    traffic: DataFrame
