"""Rows that the stream of the wide table left out, found and repaired by a batch job.

A stream join drops what comes after its watermark, and rows dated far ahead of the clock never
enter it.  Orders and lines are stored when they come in; here they are joined again by
the same rule, and what the wide table lacks is what the stream left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillflow.functions import as_cents
from tillflow.operators import wide
from tillflow.streaming.sales import split_lines


def missed(
    orders: DataFrame, lines: DataFrame, stored: DataFrame, bound: str = "10 seconds",
    order_time: str = "create_time", line_time: str = "create_time",
) -> DataFrame:
    """Joined rows of stored orders and lines that are not in ``stored``, one per line.

    All stored rows may be given, or those of some days: orders and lines up to ``bound`` apart have
    to be in it.  Lines that were sent again are in ``stored`` already.
    """
    headers = wide.order_side(orders.withColumn("_order_time", F.col(order_time)), keep=("_order_time",))
    details = wide.line_side(lines.withColumn("_line_time", F.col(line_time)), keep=("_line_time",))
    new = details.join(stored.select("order_detail_id"), "order_detail_id", "left_anti")
    apart = F.expr(f"INTERVAL {bound}")
    joined = headers.join(new, "order_id").where(
        F.col("_line_time").between(F.col("_order_time") - apart, F.col("_order_time") + apart))
    return wide.dedup_wide(joined.drop("_order_time", "_line_time"))


def repair(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``missed`` rows with ``final_detail_amount``, to be appended to the wide table.

    What the stored lines of the same orders were given counts; if the lines add up now, the last one
    of the missed gets what is left of the payment.
    """
    priced = wide.with_raw_share(rows)
    zero = F.lit(0)
    given = stored.select("order_id", "sku_num", "sku_price", "final_detail_amount")
    before = given.join(priced.select("order_id").distinct(), "order_id", "left_semi").groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_stored_n"), F.coalesce(F.sum(as_cents(given, "sku_price") * F.col("sku_num")), zero).alias("_stored_line_c"),
        F.coalesce(F.sum(as_cents(given, "final_detail_amount")), zero).alias("_stored_share_c"))
    here = priced.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_line_c"), zero).alias("_line"), F.coalesce(F.sum("_share_c"), zero).alias("_share"),
        F.max("_final_c").alias("total_final_c"), F.max("_original_c").alias("total_original_c"))
    totals = here.join(before, "order_id", "left").select(
        "order_id", "total_final_c", "total_original_c", (F.col("_n") + F.coalesce("_stored_n", zero)).alias("total_n"),
        (F.col("_line") + F.coalesce("_stored_line_c", zero)).alias("total_line_c"),
        (F.col("_share") + F.coalesce("_stored_share_c", zero)).alias("total_share_c"))
    return split_lines(priced, totals).drop("operate_time")
