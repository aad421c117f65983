"""State tests, id casts, zone-free clock arithmetic and rounded measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger import fixed_values as V


def is_bad(state: Column) -> Column:
    return state.isin(*V.BAD_STATES)


def is_succeeded(state: Column) -> Column:
    return state.isin(*V.SUCCESS_STATES)


def is_open(state: Column) -> Column:
    return state.isNull() | (state == V.RUNNING)


def as_id(text: Column) -> Column:
    """Numeric form of a textual id; NULL, not an error, for anything else."""
    return text.try_cast("bigint")


def _day_number(time: Column) -> Column:
    return F.date_diff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")


def epoch_second(time: Column) -> Column:
    """Whole seconds since 1970 of a zone-free timestamp.

    Spark's truncating and differencing functions go through the session zone, where an hour may not exist.
    """
    return _day_number(time) * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with fraction."""
    exact = lambda time: epoch_second(time) - F.second(time) + F.date_part(F.lit("SECOND"), time)
    return (exact(end) - exact(start)).cast("double")


def as_event_time(time: Column) -> Column:
    """The instant at which UTC clocks show a zone-free timestamp, for operators that need a zoned one."""
    micros = (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    return F.timestamp_micros((epoch_second(time) - F.second(time)) * 1_000_000 + micros)


def usd(amount: Column, places: int = 2) -> Column:
    """A decimal amount rounded while still exact, then handed out as a double (0 for none)."""
    return F.coalesce(F.round(amount, places).cast("double"), F.lit(0.0))


def pct(part: Column, whole: Column, when_empty: float = 0.0) -> Column:
    """part / whole in percent, two places."""
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, 2)).otherwise(F.lit(when_empty))
