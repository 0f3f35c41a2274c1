"""Week-over-week order reports as PySpark plans."""

from weekover.params import ReportParams
from weekover.sources.inputs import ReportInputs

__all__ = ["ReportInputs", "ReportParams"]
