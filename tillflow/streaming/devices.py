"""Daily active devices as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillflow import schemas
from tillflow.operators.dau import daily_devices, device_rows, with_day_hour
from tillflow.operators.parsing import typed_rows
from tillflow.streaming.running import (
    ARRIVED, DEVICE_TRIGGER, Output, Trigger, fan_out, salt_count, start_batches, start_files, with_arrival,
)


def parse_logs(raw: DataFrame) -> DataFrame:
    """Start-up logs from JSON text."""
    return typed_rows(raw, schemas.STARTUP_LOG, key="ts", observe="startup_parsed", also="common.mid")


def first_per_device_day(logs: DataFrame, watermark: str = "24 hours", salt_buckets: int | None = None) -> DataFrame:
    """The first row of every (day, device) to arrive.

    State is kept for ``watermark`` past a row's own time.  With a day or more,
    a device cannot come twice for one day: a row that arrives after the state
    is gone is older than the watermark and is left out as late (counted by
    ``running.late_rows``; ``late_devices`` finds those a day's table lacks).

    Streaming de-duplication has no map-side step, so rows are first reduced in
    ``salt_buckets`` parts per device and day, which splits a device that sends
    a large part of all rows; 1 switches that step off.
    """
    salt_buckets = salt_count(logs, salt_buckets)
    rows = (
        device_rows(with_day_hour(logs))
        .withColumn("event_time", F.timestamp_millis("ts"))
        .observe("dau_before", F.count(F.lit(1)).alias("rows"))
        .withWatermark("event_time", watermark)
    )
    if salt_buckets > 1:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("ts"), F.lit(salt_buckets)))
        rows = rows.dropDuplicatesWithinWatermark(["dt", "mid", "_salt"]).drop("_salt")
    return (
        rows.dropDuplicatesWithinWatermark(["dt", "mid"])
        .drop("event_time")
        .observe("dau_after", F.count(F.lit(1)).alias("rows"))
    )


def first_seen(logs: DataFrame) -> DataFrame:
    """The first day of every device as running state: ``mid, dt, since, last``.

    A row per device for all time, in Spark's store on disk, reduced in every map task before the
    exchange.  ``dt`` is the earliest day of the batch in which a device first came (``since``); ``last`` is its
    latest batch.
    """
    rows = with_arrival(device_rows(with_day_hour(logs)))
    return (
        rows.groupBy("mid").agg(F.min(F.struct(ARRIVED, "dt")).alias("first"), F.max(ARRIVED).alias("last"))
        .select("mid", "first.dt", F.col(f"first.{ARRIVED}").alias("since"), "last")
    )


def start_first_seen(
    raw: DataFrame, outputs: Sequence[Output], checkpoint: str, trigger: Trigger = DEVICE_TRIGGER
) -> StreamingQuery:
    """JSON logs to an index of new devices, ``mid, dt``: a device goes to the outputs once, in the batch that first has it."""
    def each(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch.where(F.col("since") == F.col("last")).select("mid", "dt"), batch_id, outputs)

    return start_batches(first_seen(parse_logs(raw)), each, checkpoint, trigger, mode="update")


def late_devices(logs: DataFrame, stored: DataFrame) -> DataFrame:
    """Device rows of ``logs`` that the stored days lack: what a batch job appends for rows that came too late."""
    return daily_devices(logs).join(stored.select("dt", "mid"), ["dt", "mid"], "left_anti")


def start(
    raw: DataFrame, path: str, checkpoint: str, trigger: Trigger = DEVICE_TRIGGER,
    watermark: str = "24 hours", salt_buckets: int | None = None, name: str | None = None,
) -> StreamingQuery:
    """JSON logs to a device table with one folder per event day."""
    rows = first_per_device_day(parse_logs(raw), watermark, salt_buckets)
    return start_files(rows, path, checkpoint, trigger, partition_by=["dt"], name=name)
