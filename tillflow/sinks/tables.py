"""Parquet tables: by day, in packs of days, by batch, and by route."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DateType, StructType

from tillflow.functions import parse_day
from tillflow.sinks.folders import names

# Column and folder of a pack: its first day.
PACK = "pack"
# Days with fewer rows share a pack.
PACK_ROWS = 100_000


def write_days(df: DataFrame, path: str, day: str = "dt") -> None:
    """Replace the days present in ``df``, leave all other days alone.

    The rebalance hint lets Spark merge small and split large partitions, so a
    busy day becomes several files and a quiet one does not become many.
    """
    (
        df.hint("rebalance", day).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    )


def pack_days(df: DataFrame, path: str, day: str = "dt", rows: int = PACK_ROWS) -> None:
    """Write a stored table anew in packs of consecutive days.

    Days are counted, and a pack is closed when it holds ``rows`` rows: quiet days share a
    file, a busy day is a pack of its own, in as many files as it needs.  Rows are
    sorted by day, so that a reader skips within a pack too.  ``df`` is read twice and should be
    a stored table.
    """
    # One row per day from here on.
    counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("_pack", F.floor(F.coalesce(before, F.lit(0)) / F.lit(rows)))
    packs = counts.select(day, F.min(day).over(Window.partitionBy("_pack")).alias(PACK))
    (
        # One row per day, so the rows themselves are exchanged once, by their pack.
        df.join(F.broadcast(packs), day, "left").hint("rebalance", PACK).sortWithinPartitions(PACK, day)
        .write.mode("overwrite").partitionBy(PACK).parquet(path)
    )


def read_days(
    spark: SparkSession, path: str, schema: StructType, first: str | dt.date | None = None, last: str | dt.date | None = None,
    day: str = "dt",
) -> DataFrame:
    """Days ``first``..``last`` of a packed table, both included; all days by default.

    Only the packs that can hold them are read, and of these only the parts.
    """
    table = spark.read.schema(StructType([*schema.fields]).add(PACK, DateType())).parquet(path)
    if first is None:
        return table.drop(PACK)
    start = parse_day(first)
    stop = start if last is None else parse_day(last)
    starts = sorted(parse_day(n.split("=")[1]) for n in names(spark, path) if n.startswith(f"{PACK}=") and n[len(PACK) + 1].isdigit())
    low = max((s for s in starts if s <= start), default=start)
    return table.where(F.col(PACK).between(F.lit(low), F.lit(stop)) & F.col(day).between(F.lit(start), F.lit(stop))).drop(PACK)


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Publish one micro-batch; a replay of the batch overwrites its own folders.

    With ``partition_by`` the batch is the last level (``dt=D/batch_id=N``), so a reader
    of one day lists and reads that day alone.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        return
    (
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by, "batch_id").parquet(path)
    )
