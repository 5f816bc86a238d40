"""Date and time expressions on zoneless timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

def season_year(day: Column, start_month: int = 1) -> Column:
    """Calendar year, or the year in which a season opening in ``start_month`` began."""
    if start_month == 1:
        return F.year(day)
    return F.year(day) - F.when(F.month(day) < start_month, 1).otherwise(0)


def day_of_week(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Full 24-hour periods from ``earlier`` to ``later`` (not calendar days).

    Subtracting zoneless timestamps gives an interval without any session-zone shift.
    """
    return F.extract(F.lit("DAY"), later - earlier).cast("int")


def on_day(ts: Column, day: dt.date) -> Column:
    """``ts`` falls on ``day``; a half-open range, so that it reaches the Parquet scan."""
    return (ts >= _midnight(day)) & (ts < _midnight(day + dt.timedelta(days=1)))


def since(ts: Column, day: dt.date) -> Column:
    return ts >= _midnight(day)


def instant(ts: dt.datetime) -> Column:
    """A zoneless timestamp literal. Passing it as text keeps the machine's zone out of it."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def within_last_days(ts: Column, as_of: dt.date, days: int) -> Column:
    return since(ts, as_of - dt.timedelta(days=days))


def _midnight(day: dt.date) -> Column:
    return instant(dt.datetime.combine(day, dt.time()))
