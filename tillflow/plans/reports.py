"""Day totals, hour curves and brand charts.  The caller renders the rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tillflow.functions import on_days, parse_day
from tillflow.operators.brand import brand_chart, brand_topn

# Fixed captions of the headline rows.
CAPTION_DAU = "新增日活"
CAPTION_NEW_MID = "新增设备"
CAPTION_ORDER_AMOUNT = "新增交易额"


def dau_total(dau: DataFrame, day: str) -> DataFrame:
    """Number of active devices on a day."""
    return dau.where(on_days(F.col("dt"), day)).agg(F.count("*").alias("dau"))


def dau_by_hour(dau: DataFrame, day: str) -> DataFrame:
    """Devices by the hour of their first start on a day."""
    return dau.where(on_days(F.col("dt"), day)).groupBy("hr").agg(F.count("*").alias("dau"))


def dau_distinct(logs: DataFrame) -> DataFrame:
    """Exact distinct devices per day, straight from the logs."""
    return logs.groupBy("dt").agg(F.countDistinct("mid").alias("dau"))


def order_amount_total(wide: DataFrame, day: str) -> DataFrame:
    """Sales of a day; null if there were none."""
    return wide.where(on_days(F.col("dt"), day)).agg(
        F.sum("final_detail_amount").alias("order_amount")
    )


def order_amount_by_hour(wide: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Sales per day and hour of the order."""
    return (
        wide.where(on_days(F.col("dt"), first, last))
        .groupBy("dt", F.hour("create_time").alias("hr"))
        .agg(F.sum("final_detail_amount").alias("order_amount"))
    )


def hour_map(by_hour: DataFrame, value: str) -> DataFrame:
    """One row per day with a map hour -> value (at most 24 entries)."""
    entry = F.struct(F.col("hr"), F.col(value))
    return by_hour.groupBy("dt").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("hours")
    )


def device_totals(dau: DataFrame, day: str, first_seen: DataFrame | None = None) -> DataFrame:
    """One row (dau, new_mid): devices active on the day, and those never seen before it.

    With an index of first days (``mid, dt``, as ``devices.start_first_seen`` keeps it) one day of both
    tables is read.  Without it the history tells: repeated rows of a device do no harm, so the logs themselves will do as well
    as the device table.  Of the days before only the devices of the day are looked up:
    history is cut to two columns and to these devices before anything is grouped.
    """
    date = F.lit(parse_day(day))
    today = dau.where(F.col("dt") == date).select("mid").distinct()
    if first_seen is not None:
        new = first_seen.where(F.col("dt") == date).agg(F.countDistinct("mid").alias("new_mid"))
        both = today.agg(F.count("*").alias("dau")).withColumn("new_mid", F.lit(0).cast("bigint")).unionByName(
            new.withColumn("dau", F.lit(0).cast("bigint")))
        return both.agg(F.sum("dau").alias("dau"), F.sum("new_mid").alias("new_mid"))
    before = dau.where(F.col("dt") < date).select("mid").join(today, "mid", "left_semi").distinct()
    return today.join(before.withColumn("known", F.lit(True)), "mid", "left").agg(
        F.count("*").alias("dau"),
        F.count_if(F.col("known").isNull()).alias("new_mid"),
    )


def day_headline(
    dau: DataFrame, wide: DataFrame, day: str, sales_day: str | None = None, first_seen: DataFrame | None = None
) -> DataFrame:
    """Three rows (id, name, value): dau, new_mid and order_amount.

    ``sales_day`` is for data sets whose logs and orders cover different periods.
    """
    amount = order_amount_total(wide, sales_day or day)
    kind = amount.schema["order_amount"].dataType
    devices = device_totals(dau, day, first_seen).select(
        F.explode(F.array(
            F.struct(F.lit("dau").alias("id"), F.lit(CAPTION_DAU).alias("name"),
                     F.col("dau").cast(kind).alias("value")),
            F.struct(F.lit("new_mid").alias("id"), F.lit(CAPTION_NEW_MID).alias("name"),
                     F.col("new_mid").cast(kind).alias("value")),
        )).alias("row")
    ).select("row.*")
    sales = amount.select(
        F.lit("order_amount").alias("id"), F.lit(CAPTION_ORDER_AMOUNT).alias("name"),
        F.col("order_amount").alias("value"),
    )
    return devices.unionByName(sales)


def hour_curve(metric: str, table: DataFrame, day: str) -> DataFrame | None:
    """(day, hr, value) with day "today" or "yesterday"; None for an unknown metric.

    ``table`` is the device table for metric "dau" and the wide table for
    "order_amount".  Both days come from one scan.
    """
    today = parse_day(day)
    yesterday = today - dt.timedelta(days=1)
    if metric == "dau":
        per_hour = (
            table.where(on_days(F.col("dt"), yesterday, today))
            .groupBy("dt", "hr").agg(F.count("*").alias("value"))
        )
    elif metric == "order_amount":
        per_hour = order_amount_by_hour(table, yesterday, today).withColumnRenamed("order_amount", "value")
    else:
        return None
    label = F.when(F.col("dt") == F.lit(today), F.lit("today")).otherwise(F.lit("yesterday"))
    return per_hour.select(label.alias("day"), "hr", "value")


def brand_report(stat: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """Top brands in chart form."""
    return brand_chart(brand_topn(stat, start, end, n))
