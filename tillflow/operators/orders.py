"""Order headers: times, first-order flag, region and buyer attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillflow.functions import age_group, gender_label
from tillflow.operators.ranking import first_per_key

CONSUMED = "1"  # fixed flag values
FIRST, NOT_FIRST = "1", "0"


def with_day_hour(orders: DataFrame, time: str = "create_time") -> DataFrame:
    """Add ``create_date`` and ``create_hour``."""
    return orders.withColumns({
        "create_date": F.to_date(time),
        "create_hour": F.hour(time),
    })


def operated(orders: DataFrame) -> DataFrame:
    """Orders that have been operated on."""
    return orders.where(F.col("operate_time").isNotNull())


def with_consumed_flag(orders: DataFrame, user_state: DataFrame) -> DataFrame:
    """``if_first_order`` from the buyer's state alone: every order of a new buyer gets "1"."""
    state = user_state.select("user_id", F.col("if_consumed").alias("_consumed"))
    return orders.join(state, "user_id", "left").withColumn(
        "if_first_order",
        F.when(F.col("_consumed") == CONSUMED, F.lit(NOT_FIRST)).otherwise(F.lit(FIRST)),
    ).drop("_consumed")


def earliest_orders(orders: DataFrame) -> DataFrame:
    """(user_id, first_order_id): each buyer's earliest order, ties to the lower id."""
    narrow = orders.select("user_id", "create_time", "id")
    return first_per_key(narrow, ["user_id"], ["create_time", "id"]).select(
        "user_id", F.col("id").alias("first_order_id")
    )


def new_buyers(earliest: DataFrame, user_state: DataFrame) -> DataFrame:
    """The rows of ``earliest`` whose buyer had not consumed before."""
    consumed = user_state.where(F.col("if_consumed") == CONSUMED).select("user_id")
    return earliest.join(consumed, "user_id", "left_anti")


def flag_orders(orders: DataFrame, first_ids: DataFrame) -> DataFrame:
    """``if_first_order``: "1" for ids in ``first_ids``, "0" for the others.

    The join is on the order id, which is unique, so a buyer with very many
    orders does not weigh on any one task.
    """
    firsts = first_ids.select(F.col("first_order_id").alias("id"), F.lit(FIRST).alias("_first"))
    return orders.join(firsts, "id", "left").withColumn(
        "if_first_order", F.coalesce("_first", F.lit(NOT_FIRST))
    ).drop("_first")


def with_first_flag(orders: DataFrame, user_state: DataFrame) -> DataFrame:
    """Exactly one "1" per buyer who had not consumed before: the earliest order."""
    return flag_orders(orders, new_buyers(earliest_orders(orders), user_state))


def new_consumed_users(flagged: DataFrame) -> DataFrame:
    """User-state rows for the buyers of first orders."""
    return flagged.where(F.col("if_first_order") == FIRST).select(
        "user_id", F.lit(CONSUMED).alias("if_consumed")
    )


def with_province(orders: DataFrame, province: DataFrame) -> DataFrame:
    """Add region columns; Spark broadcasts the regions if they are small enough."""
    dim = province.select(
        F.col("id").alias("province_id"),
        F.col("name").alias("province_name"),
        F.col("area_code").alias("province_area_code"),
        F.col("iso_code").alias("province_iso_code"),
    )
    return orders.join(dim, "province_id", "left")


def with_user(orders: DataFrame, users: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add the buyer's age bucket and gender label.

    Labels are computed on the dimension, once per buyer and not once per order.
    """
    dim = users.select(
        F.col("id").alias("user_id"),
        age_group(F.col("birthday"), as_of).alias("user_age_group"),
        gender_label(F.col("gender")).alias("user_gender"),
    )
    return orders.join(dim, "user_id", "left")


def enrich(
    orders: DataFrame, user_state: DataFrame, province: DataFrame, users: DataFrame,
    as_of: Column | None = None,
) -> DataFrame:
    """Complete order headers.

    The first orders are found on the bare orders, three columns of them.
    """
    firsts = new_buyers(earliest_orders(orders), user_state)
    labelled = with_user(with_province(with_day_hour(orders), province), users, as_of)
    return flag_orders(labelled, firsts)
