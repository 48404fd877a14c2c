"""Looking at and deleting folders on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; nothing for a folder that is not there."""
    fs, target = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def versions(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of what lies in a folder: another value once a table in it has been written anew."""
    fs, target = _open(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target)))


def move(spark: SparkSession, folder: str, into: str, prefix: str) -> None:
    """The Parquet files of a folder into another one that is there, under names with a prefix."""
    fs, target = _open(spark, into)
    for name in names(spark, folder):
        if name.endswith(".parquet") and not fs.rename(_open(spark, f"{folder}/{name}")[1], _open(spark, f"{into}/{prefix}{name}")[1]):
            raise OSError(f"{folder}/{name} could not be moved into {into}")


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _open(spark, path)
    fs.delete(target, True)
