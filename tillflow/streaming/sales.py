"""Orders, order lines, the wide table and brand sums as streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillflow import schemas
from tillflow.operators import brand, details, orders, wide
from tillflow.operators.parsing import typed_rows
from tillflow.sinks.latest import LatestTable
from tillflow.sinks.tables import write_batch
from tillflow.streaming.running import (
    ARRIVED, ORDER_COPIES, TABLE_TRIGGER, Output, Trigger, beside, fan_out, kept, landed, landing_of, row_side, salt_count, start_batches, start_files,
    with_arrival,
)

# -- topics -------------------------------------------------------------------

# Entity -> (schema, key) of the JSON rows of the sales topics.
TOPIC_ROWS = {
    "order": (schemas.ORDER_INFO, "id"),
    "detail": (schemas.ORDER_DETAIL, "id"),
    "enriched_order": (schemas.ORDER_INFO_ENRICHED, "id"),
    "enriched_detail": (schemas.ORDER_DETAIL_ENRICHED, "id"),
    "wide": (schemas.ORDER_WIDE, "order_detail_id"),
}


def parse(raw: DataFrame, entity: str) -> DataFrame:
    """Typed rows of a sales topic; unusable text is dropped and counted."""
    schema, key = TOPIC_ROWS[entity]
    return typed_rows(raw, schema, key, observe=f"{entity}_parsed")


# -- order headers ------------------------------------------------------------


def first_orders(arrived: DataFrame, known_buyers: DataFrame | None = None) -> DataFrame:
    """Each buyer's first order as running state: ``user_id, first_order_id, since, last``.

    The state of the aggregation is one row per buyer for all time, in Spark's store on
    disk, reduced in every map task before the exchange.  It begins with ``known_buyers``, a
    stream over the stored table (``user_id``) of those who had ordered before; they have no
    first order here.  The first order is the earliest one of the batch in which a buyer first
    came (``since``), so an order sent again keeps its flag, and an earlier order that comes
    later does not take it back.  ``last`` is the latest batch with an order of the buyer.
    """
    rows = arrived.select("user_id", ARRIVED, "create_time", F.col("id").alias("first_order_id"))
    if known_buyers is not None:
        none = {"create_time": rows.schema["create_time"].dataType, "first_order_id": rows.schema["first_order_id"].dataType}
        rows = rows.unionByName(known_buyers.select(
            F.col("user_id").cast(rows.schema["user_id"].dataType).alias("user_id"), F.timestamp_seconds(F.lit(0)).alias(ARRIVED),
            *(F.lit(None).cast(kind).alias(name) for name, kind in none.items())))
    return (
        rows.groupBy("user_id").agg(
            F.min(F.struct(ARRIVED, "create_time", "first_order_id")).alias("first"), F.max(ARRIVED).alias("last"))
        .where(F.col("first.first_order_id").isNotNull())
        .select("user_id", "first.first_order_id", F.col(f"first.{ARRIVED}").alias("since"), "last")
    )


def known_buyers(user_state: DataFrame) -> DataFrame:
    """The buyers of a user-state table (or a stream over one) who have ordered before."""
    return user_state.where(F.col("if_consumed") == orders.CONSUMED).select("user_id")


def dimension_rows_of(source: LatestTable | Callable[[], DataFrame], keys: Column, batch: DataFrame) -> DataFrame:
    """The rows of a dimension that a batch needs.

    A table of latest rows is looked up by the batch's keys before anything is folded; any other
    source is read as it is.
    """
    if isinstance(source, LatestTable):
        return source.read(batch.select(keys.alias(source.keys[0])))
    return source()


def order_batch(
    spark: SparkSession,
    landing: str,
    read_province: LatestTable | Callable[[], DataFrame],
    read_users: LatestTable | Callable[[], DataFrame],
    outputs: Sequence[Output],
    buyer_outputs: Sequence[Output] = (),
    as_of: Column | None = None,
) -> Output:
    """Per-batch step: complete the order headers, hand them on, and the buyers that are new.

    Dimensions are read again for every batch, so changes to them show up; tables of latest
    rows are looked up by the batch's keys.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with landed(batch, spark, landing, batch_id) as arrived:
            rows, firsts = row_side(arrived, "row").drop(ARRIVED), row_side(arrived, "state")
            if rows.isEmpty():
                return
            headers = orders.with_province(
                orders.with_day_hour(rows), dimension_rows_of(read_province, F.col("province_id"), rows))
            headers = orders.with_user(headers, dimension_rows_of(read_users, F.col("user_id"), rows), as_of)
            fan_out(orders.flag_orders(headers, firsts), batch_id, outputs)
            if buyer_outputs:
                new = firsts.where(F.col("since") == F.col("last"))
                fan_out(new.select("user_id", F.lit(orders.CONSUMED).alias("if_consumed")), batch_id, buyer_outputs)

    return each


def start_orders(
    stream: DataFrame, buyers: DataFrame | None, read_province, read_users, outputs: Sequence[Output],
    checkpoint: str, trigger: Trigger = TABLE_TRIGGER, as_of: Column | None = None, buyer_outputs: Sequence[Output] = (),
) -> StreamingQuery:
    """Typed orders to complete order headers; ``buyers`` as in ``first_orders``."""
    arrived = with_arrival(stream)
    each = order_batch(
        stream.sparkSession, landing_of(checkpoint), read_province, read_users, outputs, buyer_outputs, as_of)
    return start_batches(beside(arrived, first_orders(arrived, buyers)), each, checkpoint, trigger, mode="update")


# -- order lines --------------------------------------------------------------


Products = tuple[LatestTable, LatestTable, LatestTable, LatestTable]


def products_of(tables: Products, lines: DataFrame) -> tuple[DataFrame, ...]:
    """Products, product groups, brands and categories that some lines need, each looked up by key."""
    sku, *rest = tables
    found = sku.read(lines.select("sku_id"))
    return found, *(table.read(found.select(table.keys[0])) for table in rest)


def detail_batch(
    spark: SparkSession, landing: str, read_products: Products | Callable[[], tuple[DataFrame, ...]], outputs: Sequence[Output]
) -> Output:
    """Per-batch step: complete the order lines; dimensions are read again for every batch.

    Four tables of latest rows are looked up by the batch's products; a function gives whole dimensions.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        with landed(batch, spark, landing, batch_id) as lines:
            if lines.isEmpty():
                return
            # The look-ups ask for the products many times: each once, not the lines.
            with kept(lines.select("sku_id").distinct()) as wanted:
                products = read_products() if callable(read_products) else products_of(read_products, wanted)
                fan_out(details.enrich(lines, *products), batch_id, outputs)

    return each


def start_details(
    stream: DataFrame, read_products: Products | Callable[[], tuple[DataFrame, ...]], outputs: Sequence[Output], checkpoint: str,
    trigger: Trigger = TABLE_TRIGGER,
) -> StreamingQuery:
    """Typed order lines to complete order lines."""
    each = detail_batch(stream.sparkSession, landing_of(checkpoint), read_products, outputs)
    return start_batches(stream, each, checkpoint, trigger)


# -- wide table ---------------------------------------------------------------


def join_streams(
    order_stream: DataFrame,
    detail_stream: DataFrame,
    bound: str = "10 seconds",
    watermark: str = "24 hours",
    order_time: str = "create_time",
    line_time: str = "create_time",
    salt_buckets: int | None = None,
    ahead: str = "1 day",
    forever: bool = True,
) -> DataFrame:
    """Orders joined with lines no further than ``bound`` apart, one row per line.

    ``watermark`` is how late rows may come; state is dropped after it.  It has
    nothing to do with ``bound``: an order passes only once it has been operated on,
    with the image sent then, which carries its old creation time.  Rows later
    than that are left out and counted (``running.late_rows``), and so are rows dated more than ``ahead``
    of the clock: one wrong date must not move the watermark past everything else.  ``late.missed`` finds
    what was left out.  A line passes once, for all time: its id stays in the state, on disk;
    with ``forever=False`` only until the watermark has passed it.  An order is kept once
    per salt bucket and its lines are spread over the buckets, so one order with very
    many lines is split (by default in ``running.salt_count`` parts, ``ORDER_COPIES`` at most: state partitions
    grow with the data, and orders must not be kept once for each of them); 1 switches that off.
    """
    late = watermark
    soon = lambda time: F.col(time) <= F.current_timestamp() + F.expr(f"INTERVAL {ahead}")
    if salt_buckets is None:
        salt_buckets = min(salt_count(order_stream, None), ORDER_COPIES)
    # Only the two time columns of the join may carry a watermark; the header's
    # own times are copies.
    headers = (
        order_stream.where(soon(order_time)).withColumn("_order_time", F.col(order_time)).withWatermark("_order_time", late)
    )
    headers = wide.order_side(headers, keep=("_order_time",)).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1)))
    )
    lines = (
        wide.line_side(
            detail_stream.where(soon(line_time)).withColumn("_line_time", F.col(line_time)).withWatermark("_line_time", late),
            keep=("_line_time",),
        )
        .withColumn("_salt", F.pmod(F.xxhash64("order_detail_id"), F.lit(salt_buckets)).cast("int"))
        .withColumnsRenamed({"order_id": "_line_order", "_salt": "_line_salt"})
    )
    apart = F.expr(f"INTERVAL {bound}")
    joined = headers.join(
        lines,
        (F.col("order_id") == F.col("_line_order"))
        & (F.col("_salt") == F.col("_line_salt"))
        & (F.col("_line_time") >= F.col("_order_time") - apart)
        & (F.col("_line_time") <= F.col("_order_time") + apart),
    ).drop("_line_order", "_salt", "_line_salt", "_line_time")
    once = joined.dropDuplicates if forever else joined.dropDuplicatesWithinWatermark
    return once(["order_detail_id"]).drop("_order_time")


def start_join(
    joined: DataFrame, path: str, checkpoint: str, trigger: Trigger = TABLE_TRIGGER, partitions: int | None = None,
    count_state: bool = False,
) -> StreamingQuery:
    """Joined rows (see ``join_streams``) to a table, which the split and the repair of late rows read.

    Every line is put into the state twice and most are deleted from it, so its rows are counted only on request.
    """
    return start_files(joined, path, checkpoint, trigger, partitions=partitions, count_state=count_state)


def order_totals(priced: DataFrame, bound: str = "10 seconds", watermark: str = "24 hours") -> DataFrame:
    """What the lines of each order have added up to so far, as running state.

    Sums are reduced in every map task, so an order with very many lines is a row per
    task.  An order's row is dropped by the operator's own watermark.  Lines come out of the
    join up to ``bound`` before or after its watermark, which may be ahead of this
    one by another bound; so no line of the join can be late here.
    """
    return (
        priced.withWatermark("create_time", f"{watermark} {bound} {bound}")
        .groupBy("order_id", "create_time")
        .agg(
            F.count(F.lit(1)).alias("total_n"),
            F.coalesce(F.sum("_line_c"), F.lit(0)).alias("total_line_c"),
            F.coalesce(F.sum("_share_c"), F.lit(0)).alias("total_share_c"),
            F.max("_final_c").alias("total_final_c"),
            F.max("_original_c").alias("total_original_c"),
        )
    )


def split_lines(priced: DataFrame, totals: DataFrame) -> DataFrame:
    """New lines with ``final_detail_amount``, where ``totals`` has the sums of their orders with these lines.

    Lines of an order may come in several batches.  When they add up to the order's
    original total, the highest line id of the batch gets what is left of the payment.
    Amounts of lines are not negative, so what comes after that adds nothing (lines
    of no amount): it takes back its own share.
    """
    here = priced.groupBy("order_id").agg(
        F.max("order_detail_id").alias("order_detail_id"), F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum("_line_c"), F.lit(0)).alias("_here_c"), F.coalesce(F.sum("_share_c"), F.lit(0)).alias("_given_c"))
    original = F.col("total_original_c")
    before = (F.col("total_n") > F.col("_n")) & (F.col("total_line_c") - F.col("_here_c") == original)
    left = F.when(before, -F.col("_given_c")).otherwise(F.col("total_final_c") - F.col("total_share_c"))
    left_over = (
        here.join(totals, "order_id").where(F.col("total_line_c") == original)
        .select("order_detail_id", left.alias("_left_c"), original.alias("_original"))
        .where((F.col("_left_c") != 0) | (F.col("_original") <= 0)).drop("_original")
    )
    return wide.finish_share(wide.add_leftover(priced, left_over))


def split_batch(spark: SparkSession, landing: str, outputs: Sequence[Output]) -> Output:
    """Per-batch step: apportion and hand on."""

    def each(batch: DataFrame, batch_id: int) -> None:
        with landed(batch, spark, landing, batch_id) as arrived:
            rows = row_side(arrived, "row")
            if not rows.isEmpty():
                fan_out(split_lines(rows, row_side(arrived, "state")).drop("operate_time"), batch_id, outputs)

    return each


def start_split(
    rows: DataFrame, outputs: Sequence[Output], checkpoint: str, trigger: Trigger = TABLE_TRIGGER,
    bound: str = "10 seconds", watermark: str = "24 hours", count_state: bool = False,
) -> StreamingQuery:
    """A stream over the table of ``start_join`` to the apportioned wide table.

    ``bound`` and ``watermark`` are those of the join, ``count_state`` is as there.
    """
    priced = wide.with_raw_share(rows)
    each = split_batch(rows.sparkSession, landing_of(checkpoint), outputs)
    return start_batches(beside(priced, order_totals(priced, bound, watermark)), each, checkpoint, trigger, mode="update", count_state=count_state)


# -- sums by hour -------------------------------------------------------------


def hour_table(spark: SparkSession, path: str) -> LatestTable:
    """Sales per day and hour."""
    return LatestTable(spark, path, "dt date, hr int, order_amount decimal(38,2)", ("dt", "hr"))


def start_hours(
    wide_stream: DataFrame, table: LatestTable, checkpoint: str, trigger: Trigger = TABLE_TRIGGER, watermark: str = "24 hours"
) -> StreamingQuery:
    """Wide rows to sales per hour, kept current: a batch writes the new sums of the hours it has rows of."""
    sums = (
        wide_stream.withWatermark("create_time", watermark).groupBy(F.window("create_time", "1 hour"))
        .agg(F.sum("final_detail_amount").alias("order_amount"))
        .select(F.to_date("window.start").alias("dt"), F.hour("window.start").alias("hr"), "order_amount")
    )
    return start_batches(sums, table.write, checkpoint, trigger, mode="update")


# -- brand sums ---------------------------------------------------------------


def brand_batch(path: str) -> Output:
    """Per-batch step: sales per brand under the batch's stamp, replaced as a whole on a replay.

    Result and source position belong together through the batch id: a batch is
    either complete under its id or done again under the same id.  The stamp is a column of the
    batch (see ``start_brand``), so a replay after midnight still writes the same day.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sums = brand.brand_sums(batch, F.col(ARRIVED), by=(ARRIVED,))
        write_batch(sums.withColumn("dt", F.to_date("stat_time")), path, batch_id, ("dt",))

    return each


def start_brand(wide_stream: DataFrame, path: str, checkpoint: str, trigger: Trigger = TABLE_TRIGGER) -> StreamingQuery:
    """Wide rows to brand sums per batch.

    The stamp is the time at which the batch was planned; the checkpoint keeps it for a replay.
    """
    return start_batches(with_arrival(wide_stream), brand_batch(path), checkpoint, trigger)
