"""Shared helpers: written tables that cut lineage, and row locators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.session import scratch_dir
from tillflow.sinks.folders import delete

# Where a row is: names that no input column is likely to have.
FILE, ROW = "_at_file", "_at_row"


# Folders written inside ``passing``, innermost block last.
_PASSING: list[list[str]] = []


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables landed inside are deleted at the end of the block, except those that stay."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            delete(spark, path)


def land(df: DataFrame, label: str, stays: bool = False, **options: str) -> DataFrame:
    """Write a result to the shared scratch folder and read it back.

    The copy cuts the lineage and survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    if _PASSING and not stays:
        _PASSING[-1].append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(df: DataFrame) -> DataFrame:
    """The rows with the file and the position they are stored at.

    A frame that is not a scan of files is landed first, so that every row has a
    locator that stays the same whenever the frame is computed again.  Located
    rows are returned as they are.
    """
    if {FILE, ROW} <= {*df.columns}:
        return df

    def add(rows: DataFrame) -> DataFrame:
        meta = rows.metadataColumn("_metadata")
        return rows.select("*", meta["file_path"].alias(FILE), meta["row_index"].alias(ROW))

    try:
        return add(df)
    except AnalysisException:
        return add(land(df, "rows"))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Located rows except the dropped locators; the locator columns go.

    The locators are written first, so that Spark knows their size: a short list
    needs no exchange of the rows.
    """
    return rows.join(land(dropped.select(FILE, ROW), "dropped"), [FILE, ROW], "left_anti").drop(FILE, ROW)


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(texts: DataFrame) -> DataFrame:
    """The frame, for Python: batches of texts then have a thousand rows at most.

    A batch is held several times, in Spark's buffers and in Python; texts make it
    large long before ten thousand rows.
    """
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return texts


def most_frequent(rows: DataFrame, count: str, top: int) -> DataFrame:
    """Rows with the largest counts, at most ``top`` of them.

    A histogram of the counts, of a thousand steps at most, gives the least count that
    keeps within the bound; no rows are sorted or gathered.  Counts below one are the smallest.  Rows of the step at which the
    bound is passed are left out together.
    """
    step = F.coalesce(F.floor(F.log2(count) * 16).cast("int"), F.lit(-1))
    least, taken = None, 0
    for row in sorted(rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: r.step, reverse=True):
        taken += row.k
        if taken > top:
            break
        least = row.step
    return rows.filter(F.lit(False) if least is None else step >= least)


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
