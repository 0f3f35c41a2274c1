"""Parameters of a report run. Nothing in the library reads the wall clock."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta

# Report clusters, most used first.
CLUSTERS = ("tier_next", "tier_2", "tier_3", "tier_1")

# Characters of a cluster label that stand for an underscore.
LABEL_GAPS = " +"

# Platforms whose sessions count as app traffic.
APP_PLATFORMS = ("Android", "iOS")


@dataclass(frozen=True)
class ReportParams:
    """``as_of`` is the clock of the run; ``clusters`` bounds every per-cluster frame."""

    as_of: datetime
    clusters: tuple[str, ...] = CLUSTERS
    default_cluster: str = "tier_next"
    compare_days: int = 7
    lookback_days: int = 90
    banner_threshold: float = 1.6
    platforms: tuple[str, ...] = APP_PLATFORMS

    @property
    def today(self) -> date:
        return self.as_of.date()

    @property
    def last_week(self) -> date:
        return self.today - timedelta(days=self.compare_days)

    @property
    def lookback_start(self) -> date:
        return self.today - timedelta(days=self.lookback_days)

    @property
    def now(self) -> str:
        """The clock as an SQL literal."""
        return f"cast('{self.as_of}' AS timestamp_ntz)"

    def for_cluster(self, label: str) -> ReportParams:
        """The same run for one cluster, named in any spelling; unknown ones mean the default."""
        slug = label.lower().translate(str.maketrans(dict.fromkeys(LABEL_GAPS, "_")))
        return replace(self, clusters=(slug if slug in self.clusters else self.default_cluster,))

    @property
    def as_of_text(self) -> str:
        return self.as_of.strftime("%Y-%m-%d %H:%M:%S")
