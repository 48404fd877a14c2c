"""Days, hours and ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def parse_day(text: str | dt.date) -> dt.date:
    """Strict ``yyyy-MM-dd``; raises ValueError before any job is started."""
    if isinstance(text, dt.datetime):
        return text.date()
    if isinstance(text, dt.date):
        return text
    return dt.datetime.strptime(text, "%Y-%m-%d").date()


def on_days(day: Column, first: str | dt.date, last: str | dt.date | None = None) -> Column:
    """Day column within ``first``..``last``, both included (one day by default)."""
    start = parse_day(first)
    stop = start if last is None else parse_day(last)
    if start == stop:
        return day == F.lit(start)
    return (day >= F.lit(start)) & (day <= F.lit(stop))


def day_between(moment: Column, first: str | dt.date, last: str | dt.date | None = None) -> Column:
    """Time column within whole days ``first``..``last``, in a form a Parquet scan can use."""
    start = parse_day(first)
    stop = (start if last is None else parse_day(last)) + dt.timedelta(days=1)
    as_time = lambda d: F.lit(f"{d} 00:00:00")
    return (moment >= as_time(start)) & (moment < as_time(stop))


def open_range(moment: Column, start: str, end: str) -> Column:
    """Both ends excluded."""
    return (moment > F.lit(start).cast("timestamp")) & (moment < F.lit(end).cast("timestamp"))
