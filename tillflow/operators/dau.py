"""Daily active devices from start-up logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillflow.operators.ranking import first_per_key

MINUTE = "00"  # fixed value of column mi


def with_day_hour(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``dt`` and ``hr`` from epoch milliseconds, cut in the session time zone."""
    at = F.timestamp_millis(F.col(ts))
    return df.withColumns({"dt": F.to_date(at), "hr": F.hour(at)})


def device_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Flat device rows of a start-up log that already has ``dt`` and ``hr``; logs without a device are no device."""
    return df.where(F.col("common.mid").isNotNull()).select(
        "common.mid", "common.uid", "common.ar", "common.ch", "common.vc",
        "dt", "hr", F.lit(MINUTE).alias("mi"), "ts", *keep,
    )


def first_per_device_day(df: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """The first row of every (day, device)."""
    rest = [c for c in ("uid", "ar", "ch", "vc") if c not in tie_break]
    return first_per_key(df, ["dt", "mid"], ["ts", *tie_break, *rest])


def daily_devices(logs: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Start-up logs to one row per (day, device)."""
    rows = device_rows(with_day_hour(logs), keep=tie_break)
    return first_per_device_day(rows, tie_break).drop(*tie_break)
