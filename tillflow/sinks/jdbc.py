"""Appends to a relational table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_options(
    url: str, table: str, driver: str | None = None,
    batch_size: int = 1000, isolation: str = "NONE", partitions: int | None = None,
) -> dict[str, str]:
    """Writer options; ``partitions`` bounds the parallel writers, 1 is for a database that takes only one."""
    options = {"url": url, "dbtable": table, "batchsize": str(batch_size), "isolationLevel": isolation}
    if partitions:
        options["numPartitions"] = str(partitions)
    return {**options, "driver": driver} if driver else options


def append(df: DataFrame, url: str, table: str, **kwargs) -> None:
    df.write.format("jdbc").mode("append").options(**append_options(url, table, **kwargs)).save()
