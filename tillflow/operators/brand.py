"""Sales per brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.functions import on_days, open_range


def brand_sums(lines: DataFrame, stat_time: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(stat_time, trademark_id, trademark_name, amount) of one batch.

    ``stat_time`` is one stamp for the batch, or a function of the columns in ``by``.
    """
    amount = F.sum("final_detail_amount").alias("amount")
    return (
        lines.groupBy("tm_id", "tm_name", *by).agg(amount)
        .select(
            stat_time.alias("stat_time"),
            F.col("tm_id").alias("trademark_id"),
            F.col("tm_name").alias("trademark_name"),
            "amount",
        )
    )


def brand_topn(stat: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """The ``n`` brands with the highest sales strictly between ``start`` and ``end``.

    Of a table stored by ``dt``, the day of ``stat_time``, only these days are read.
    """
    if "dt" in stat.columns:
        stat = stat.where(on_days(F.col("dt"), start[:10], end[:10]))
    return (
        stat.where(open_range(F.col("stat_time"), start, end))
        .groupBy("trademark_id", "trademark_name")
        .agg(F.sum("amount").alias("order_amount"))
        .orderBy(F.col("order_amount").desc(), F.col("trademark_id"))
        .limit(n)
    )


def brand_chart(topn: DataFrame) -> DataFrame:
    """Chart points: name, amount and series."""
    return topn.select(
        F.col("trademark_name").alias("x"), F.col("order_amount").alias("y"), F.lit(1).alias("s")
    )
