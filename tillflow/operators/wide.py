"""Orders joined with their lines, de-duplicated, with the payment split over the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillflow.functions import as_cents, from_cents, share_cents
from tillflow.operators.orders import operated
from tillflow.operators.ranking import first_per_key

ORDER_COLUMNS = (
    "order_status", "create_time", "user_id", "benefit_reduce_amount", "original_total_amount",
    "feight_fee", "final_total_amount", "if_first_order", "province_name", "province_area_code",
    "user_age_group", "user_gender",
)
LINE_COLUMNS = (
    "sku_id", "sku_num", "sku_name", "spu_id", "tm_id", "category3_id",
    "spu_name", "tm_name", "category3_name",
)


def order_side(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Header columns of the wide table (those that are present)."""
    present = [c for c in ORDER_COLUMNS if c in orders.columns]
    return operated(orders).select(
        F.col("id").alias("order_id"), *present,
        F.to_date("create_time").alias("dt"), "operate_time", *keep,
    )


def line_side(details: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Line columns of the wide table (those that are present)."""
    present = [c for c in LINE_COLUMNS if c in details.columns]
    return details.select(
        F.col("id").alias("order_detail_id"), "order_id",
        F.col("order_price").alias("sku_price"), *present, *keep,
    )


def join_wide(orders: DataFrame, details: DataFrame) -> DataFrame:
    """One flat row per (order image, line); the header's ``create_time`` is kept."""
    return order_side(orders).join(line_side(details), "order_id")


def join_once(orders: DataFrame, details: DataFrame) -> DataFrame:
    """One row per line: the line once, however often it was sent, with the earliest image of its order.

    Both sides are reduced before they are joined, while they are narrow; of each key one
    row per map task goes through an exchange.
    """
    headers = first_per_key(
        order_side(orders), ["order_id"], ["operate_time", "create_time", "final_total_amount", "original_total_amount"])
    lines = line_side(details)
    lines = first_per_key(lines, ["order_detail_id"], [c for c in lines.columns if c != "order_detail_id"])
    return headers.join(lines, "order_id")


def dedup_wide(wide: DataFrame) -> DataFrame:
    """One row per line: the one with the earliest order image."""
    # The amounts settle ties, so that every evaluation picks the same image.
    return first_per_key(
        wide, ["order_detail_id"],
        ["operate_time", "create_time", "final_total_amount", "original_total_amount"],
    )


def apportion(wide: DataFrame, residual: str = "last") -> DataFrame:
    """Add ``final_detail_amount``, each line's share of the order's payment.

    A line gets ``sku_num * sku_price * final / original`` rounded to the cent.
    With ``residual="last"`` the last line (highest id) gets what is left, so the
    shares of an order add up to its payment exactly; ``residual="none"`` leaves
    the rounding differences out.

    No ordered pass over an order's lines is needed: what is left for the last
    line is the payment minus the sum of the other shares.  That sum is an
    ordinary aggregate, combined before the exchange.  It is then joined to the lines by the order,
    by which they lie already where they come from a join of orders and lines: they are not
    exchanged again, unless an order has so many lines that adaptive execution splits it.
    """
    if residual not in ("last", "none"):
        raise ValueError(f"residual must be 'last' or 'none', not {residual!r}")
    priced = with_raw_share(wide)
    if residual == "last":
        priced = add_leftover_by_order(priced, leftovers(priced))
    return finish_share(priced)


def with_raw_share(wide: DataFrame) -> DataFrame:
    """Add the amounts of the split in cents: a line's own, the order's, and the rounded share."""
    in_cents = wide.withColumns({
        "_line_c": as_cents(wide, "sku_price") * F.col("sku_num"),
        "_final_c": as_cents(wide, "final_total_amount"),
        "_original_c": as_cents(wide, "original_total_amount"),
    })
    return in_cents.withColumn("_share_c", share_cents("_line_c", "_final_c", "_original_c"))


def finish_share(priced: DataFrame) -> DataFrame:
    """``final_detail_amount`` in the unit of the order's payment, without the helper columns."""
    unit = priced.schema["final_total_amount"].dataType
    return priced.withColumn("final_detail_amount", from_cents(F.col("_share_c"), unit)).drop(
        "_line_c", "_final_c", "_original_c", "_share_c"
    )


def leftovers(priced: DataFrame) -> DataFrame:
    """(order_id, order_detail_id, _left_c) of the last line of every order whose shares do not add up.

    An order has a last line only if its lines make up its original total; while
    one is missing, every line has its own share, as in the stream.
    """
    return (
        priced.groupBy("order_id")
        .agg(
            F.max("order_detail_id").alias("order_detail_id"),
            (F.max("_final_c") - F.coalesce(F.sum("_share_c"), F.lit(0))).alias("_left_c"),
            F.max("_original_c").alias("_original_c"),
            F.coalesce(F.sum("_line_c"), F.lit(0)).alias("_sum_c"),
        )
        .where(F.col("_sum_c") == F.col("_original_c"))
        .where((F.col("_left_c") != 0) | (F.col("_original_c") <= 0))
        .select("order_id", "order_detail_id", "_left_c")
    )


def add_leftover(priced: DataFrame, left_over: DataFrame) -> DataFrame:
    """Add ``_left_c`` to the share of the lines named in ``left_over``."""
    return _with_left(priced.join(left_over, "order_detail_id", "left")).drop("_left_c")


def add_leftover_by_order(priced: DataFrame, left_over: DataFrame) -> DataFrame:
    """The same for ``left_over`` with one line of an order, joined by the order."""
    last = left_over.withColumnsRenamed({"order_detail_id": "_last", "_left_c": "_order_left_c"})
    left = F.when(F.col("order_detail_id") == F.col("_last"), F.col("_order_left_c"))
    return _with_left(priced.join(last, "order_id", "left").withColumn("_left_c", left)).drop("_left_c", "_order_left_c", "_last")


def _with_left(joined: DataFrame) -> DataFrame:
    return joined.withColumn(
        "_share_c",
        F.when(F.col("_left_c").isNotNull(), F.coalesce("_share_c", F.lit(0)) + F.col("_left_c"))
        .otherwise(F.col("_share_c")),
    )


def wide_table(
    orders: DataFrame, details: DataFrame, residual: str = "last", plain_orders: DataFrame | None = None
) -> DataFrame:
    """Join, de-duplicate and apportion.

    Orders and lines are de-duplicated first, while they are narrow.  The wide rows lie by order then, on which the
    left-over amounts are joined.

    ``plain_orders`` are the same orders before enrichment.  Where ``orders`` is
    not a stored table, giving them spares the sums of the split all the joins
    of the enrichment.
    """
    rows = join_once(orders, details)
    if residual != "last":
        return apportion(rows, residual).drop("operate_time")
    sums = rows if plain_orders is None else join_once(plain_orders, details)
    left_over = leftovers(with_raw_share(sums))
    return finish_share(add_leftover_by_order(with_raw_share(rows), left_over)).drop("operate_time")
