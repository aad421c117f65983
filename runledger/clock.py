"""The reference time of a report.

Every operator takes a ``Clock`` instead of reading the wall clock, so a result depends on its
inputs alone. Bounds are literals on the raw column, which lets Spark push them into the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: datetime) -> Column:
    """A zone-free timestamp literal (``F.lit(datetime)`` would give a zoned one)."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def check_range(name: str, value: float, low: float, high: float | None = None) -> None:
    """Reject a parameter outside its documented range."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be between {low} and {high if high is not None else 'unlimited'}: {value}")


@dataclass(frozen=True)
class Clock:
    as_of: datetime

    @property
    def today(self) -> date:
        return self.as_of.date()

    def now(self) -> Column:
        return ntz(self.as_of)

    def midnight(self, days_back: int = 0) -> datetime:
        return datetime.combine(self.today - timedelta(days=days_back), datetime.min.time())

    def since_days(self, time: Column, days: int) -> Column:
        """From midnight ``days`` ago up to now."""
        return (time >= ntz(self.midnight(days))) & (time <= self.now())

    def since_hours(self, time: Column, hours: int) -> Column:
        """The last ``hours`` hours up to now."""
        return (time >= ntz(self.as_of - timedelta(hours=hours))) & (time <= self.now())

    def on_dates(self, day: Column, days: int) -> Column:
        """Dates from ``days`` ago up to and including today."""
        return (day >= F.lit(self.today - timedelta(days=days))) & (day <= F.lit(self.today))
