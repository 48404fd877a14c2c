"""The driver's tables sent through the streaming operators.

A table is written once, cut into slices of its time (or key) column, and the
slices arrive one after the other; after each arrival the query is started from
its checkpoint, takes everything new, and stops.  So every query here goes
through several batches and several restarts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillflow import schemas
from tillflow.checks.queries import as_of, cdc_images, lines_split, plain, products
from tillflow.operators import details, wide
from tillflow.operators.parsing import json_column, sorted_rows
from tillflow.session import configure, scratch_dir
from tillflow.sinks.folders import delete, move, names
from tillflow.sinks.latest import LatestTable
from tillflow.sinks.outputs import to_messages, to_table
from tillflow.sinks.tables import pack_days, read_days, write_batch
from tillflow.sources.files import file_stream
from tillflow.sources.shop import ShopTables
from tillflow.streaming import changes, devices, late, progress, sales
from tillflow.streaming.running import ONCE, start_sorted


SLICE = "_slice"


class Arrivals:
    """A table arriving in ``slices`` parts, cut at equal distances of ``by``.

    It is written once, a folder per slice, and arrives by moving the files.  ``positions`` has the same
    lowest and highest ``by``, for less work than ``df``.
    """

    def __init__(self, df: DataFrame, folder: str, by: str, slices: int = 3, positions: DataFrame | None = None):
        self.spark, self.schema, self.by, self.slices = df.sparkSession, df.schema, by, slices
        self.positions = df if positions is None else positions
        self.df, self.staged, self.incoming = df, f"{folder}/staged", f"{folder}/incoming"
        # So that the stream can be described before anything has arrived.
        df.limit(0).write.parquet(self.incoming)
        self.bounds = None

    def _position(self):
        kind = self.schema[self.by].dataType.simpleString()
        return F.unix_micros(self.by) if kind == "timestamp" else F.col(self.by).cast("bigint")

    def cut(self, bounds: tuple[int, int] | None = None) -> tuple[int, int]:
        """Lowest and highest position; another table's bounds cut both alike."""
        at = self._position()
        if bounds is None:
            bounds = tuple(self.positions.agg(F.min(at), F.max(at)).first())
        low, high = self.bounds = bounds
        width = max((high - low) // self.slices + 1, 1)
        number = F.greatest(F.lit(0), F.least(F.lit(self.slices - 1), F.floor((at - F.lit(low)) / F.lit(width))))
        if self.slices > 1:
            # Rows without a position are in no slice.
            number = F.when(at.isNotNull(), number)
        self.df.withColumn(SLICE, number.cast("int")).write.partitionBy(SLICE).parquet(self.staged)
        return bounds

    def arrive(self, number: int) -> None:
        move(self.spark, f"{self.staged}/{SLICE}={number}", self.incoming, f"slice{number}-")

    def stream(self) -> DataFrame:
        return file_stream(self.spark, self.incoming, self.schema)

    def arrived(self) -> DataFrame:
        """What has come in so far, as a stored table."""
        return self.spark.read.schema(self.schema).parquet(self.incoming)

    def discard(self) -> None:
        """Drop the copies; what the query has made of them is elsewhere."""
        for folder in (self.staged, self.incoming):
            delete(self.spark, folder)


def run_through(arrivals: list[Arrivals], *starts: Callable[[], StreamingQuery], keep: bool = False) -> None:
    """Let the slices arrive in turn, and run the queries, one after the other, to the end of each.

    With ``keep`` the copies stay for steps that read what has come in.
    """
    bounds = None
    for table in arrivals:
        bounds = table.cut(bounds)
    for number in range(arrivals[0].slices):
        for table in arrivals:
            table.arrive(number)
        for start in starts:
            start().awaitTermination()
    if not keep:
        for table in arrivals:
            table.discard()


def forget_commit(spark: SparkSession, checkpoint: str) -> None:
    """Take the mark of the newest batch away, as if the query had died before it: the next start does it again."""
    done = [int(n) for n in names(spark, f"{checkpoint}/commits") if n.isdigit()]
    delete(spark, f"{checkpoint}/commits/{max(done)}")


def stored_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_dau_rows(shop: ShopTables, work: str) -> DataFrame:
    # Which start of a device comes first depends on arrival, so only the keys are compared.
    logs = shop.startup().select(json_column("common", "ts").alias("value"), "ts")
    source = Arrivals(logs, f"{work}/logs", by="ts")
    run_through([source], lambda: devices.start(source.stream(), f"{work}/out", f"{work}/check", ONCE))
    return read(shop.spark, f"{work}/out").select("dt", "mid")


def _stream_cdc(envelopes: DataFrame, form: str, work: str) -> DataFrame:
    # Envelopes have no order of their own; any split into arrivals will do.
    keyed = envelopes.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(1 << 20)))
    source = Arrivals(keyed, f"{work}/envelopes", by="part", slices=2)
    run_through(
        [source],
        lambda: changes.start_split_files(source.stream(), form, f"{work}/out", f"{work}/check", ONCE),
    )
    return cdc_images(read(envelopes.sparkSession, f"{work}/out"))


def stream_cdc_explode(shop: ShopTables, work: str) -> DataFrame:
    return _stream_cdc(shop.cdc_array(), "array", work)


def stream_cdc_route(shop: ShopTables, work: str) -> DataFrame:
    return _stream_cdc(shop.cdc_object(), "object", work)


def stream_dim_upsert(shop: ShopTables, work: str) -> DataFrame:
    images = shop.province_changes().select(
        json_column("id", "name", "area_code", "iso_code").alias("value"), F.col("seq").cast("bigint").alias("seq")
    )
    source = Arrivals(images, f"{work}/images", by="seq", slices=2)
    table = changes.dimension_table(shop.spark, f"{work}/table", "province")
    run_through(
        [source], lambda: changes.start_load(source.stream(), "province", table, f"{work}/check", trigger=ONCE)
    )
    return table.read().drop("seq")


def _stream_dimension(dimension: str):
    """Every row comes twice: first with nothing but its key, then as it is."""
    def build(shop: ShopTables, work: str) -> DataFrame:
        ddl, key = schemas.DIMENSIONS[dimension]
        fields = {column: field for field, column in schemas.SOURCE_FIELDS.get(dimension, {}).items()}
        table = {"user": shop.users, "sku": shop.sku, "spu": shop.spu, "trademark": shop.trademark, "category3": shop.category3}
        rows = table[dimension]().select(*(F.col(c).cast("string").alias(fields.get(c, c)) for c in schemas.columns(ddl)))
        bare = rows.select(*(F.col(c) if c == fields.get(key, key) else F.lit(None).cast("string").alias(c) for c in rows.columns))
        image = json_column(*rows.columns).alias("value")
        images = bare.select(image, F.lit(1).cast("bigint").alias("seq")).unionByName(
            rows.select(image, F.lit(2).cast("bigint").alias("seq")))
        source = Arrivals(images, f"{work}/images", by="seq", slices=2)
        stored = changes.dimension_table(shop.spark, f"{work}/table", dimension)
        run_through(
            [source], lambda: changes.start_load(source.stream(), dimension, stored, f"{work}/check", trigger=ONCE)
        )
        return stored.rewrite(f"{work}/rewritten").read().drop("seq")

    build.__name__ = f"stream_dim_{dimension}"
    return build


def known_buyers(shop: ShopTables, work: str) -> Callable[[], DataFrame]:
    """The stored buyers, as a stream that a state can begin with."""
    table = stored_table(shop.user_state(), f"{work}/user_state")
    return lambda: sales.known_buyers(file_stream(shop.spark, f"{work}/user_state", table.schema))


def stream_orders_by_day(shop: ShopTables, work: str) -> DataFrame:
    """Complete orders go to a table and to a topic, and the table is packed by day; rows count that have reached both."""
    source, buyers = Arrivals(shop.order_info(), f"{work}/orders", by="create_time"), known_buyers(shop, work)
    outputs = [to_table(f"{work}/batches", "create_date"), to_messages(f"{work}/topic", key="id")]
    run_through(
        [source],
        lambda: sales.start_orders(
            source.stream(), buyers(), shop.province, shop.users, outputs, f"{work}/check", ONCE, as_of()
        ),
    )
    batches = read(shop.spark, f"{work}/batches").drop("batch_id")
    pack_days(batches, f"{work}/days", "create_date")
    sent = read(shop.spark, f"{work}/topic").select(F.get_json_object("value", "$.id").cast("bigint").alias("id"))
    days = read_days(shop.spark, f"{work}/days", batches.schema).select("id", "user_id", "if_first_order", "create_date", "create_hour")
    return days.join(sent, "id")


def product_tables(shop: ShopTables, work: str) -> tuple[LatestTable, ...]:
    """The product dimensions as tables of latest rows."""
    out = []
    for name, rows in zip(("sku", "spu", "trademark", "category3"), products(shop), strict=True):
        table = changes.dimension_table(shop.spark, f"{work}/{name}", name)
        table.seed(rows.withColumn("seq", F.lit(0).cast("bigint")))
        out.append(table)
    return tuple(out)


def stream_detail_enriched(shop: ShopTables, work: str) -> DataFrame:
    source = Arrivals(shop.order_detail(), f"{work}/lines", by="order_id")
    tables = product_tables(shop, work)
    out = lambda df, batch_id: write_batch(df, f"{work}/out", batch_id)
    run_through([source], lambda: sales.start_details(source.stream(), tables, [out], f"{work}/check", ONCE))
    return plain(
        read(shop.spark, f"{work}/out"), "id", "order_id", "sku_id", "sku_num", "price_c",
        "spu_id", "tm_id", "category3_id", "spu_name", "tm_name", "category3_name",
    )


def stream_order_first_flag(shop: ShopTables, work: str) -> DataFrame:
    """The last batch of the first arrival is done twice, as after a failure."""
    source, buyers = Arrivals(shop.order_info(), f"{work}/orders", by="create_time"), known_buyers(shop, work)
    # Buyers are looked up in a table of latest rows.
    users = changes.dimension_table(shop.spark, f"{work}/users", "user")
    users.seed(shop.users().withColumn("seq", F.lit(0).cast("bigint")))
    out = lambda df, batch_id: write_batch(df, f"{work}/out", batch_id)
    starts = [0]

    def start() -> StreamingQuery:
        if starts[0] == 1:
            forget_commit(shop.spark, f"{work}/check")
        starts[0] += 1
        return sales.start_orders(source.stream(), buyers(), shop.province, users, [out], f"{work}/check", ONCE, as_of())

    run_through([source], start)
    return read(shop.spark, f"{work}/out").select(
        "id", "user_id", "if_first_order", "province_name", "user_age_group", "user_gender"
    )


def stream_new_buyers(shop: ShopTables, work: str) -> DataFrame:
    """User-state rows of the buyers who order for the first time, each written once."""
    source, buyers = Arrivals(shop.order_info(), f"{work}/orders", by="create_time"), known_buyers(shop, work)
    out = lambda df, batch_id: write_batch(df, f"{work}/out", batch_id)
    run_through([source], lambda: sales.start_orders(
        source.stream(), buyers(), shop.province, shop.users, [lambda df, batch_id: None], f"{work}/check", ONCE, as_of(), [out]))
    return read(shop.spark, f"{work}/out").select("user_id", "if_consumed")


def _joined_streams(shop: ShopTables, work: str) -> tuple[list[Arrivals], Callable[[], DataFrame]]:
    headers, lines = _timed(shop)
    sources = [
        Arrivals(headers, f"{work}/orders", by="create_time", positions=shop.order_times()),
        Arrivals(lines, f"{work}/lines", by="create_time"),
    ]
    return sources, lambda: sales.join_streams(sources[0].stream(), sources[1].stream())


def _timed(shop: ShopTables) -> tuple[DataFrame, DataFrame]:
    """Orders, and lines that follow their order by as many seconds as their number."""
    lines = shop.order_detail().join(shop.order_times().drop("operate_time"), "order_id").withColumn(
        "create_time", F.col("create_time") + F.make_dt_interval(secs=F.col("line_number"))
    ).drop("line_number")
    return shop.order_info(), lines


WIDE = ("order_detail_id", "order_id", "user_id", "sku_id", "sku_num", "line_c", "orig_c", "final_c", "dt", "create_time")


def stream_order_wide(shop: ShopTables, work: str) -> DataFrame:
    sources, joined = _joined_streams(shop, work)
    run_through(sources, lambda: sales.start_join(joined(), f"{work}/out", f"{work}/check", ONCE))
    return plain(read(shop.spark, f"{work}/out"), *WIDE)


def stream_order_wide_resent(shop: ShopTables, work: str) -> DataFrame:
    """Every order and line is sent again when all have come, dated eight years on: each line counts once."""
    again = lambda df: df.withColumn("arrival", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "create_time", F.expr("CASE WHEN arrival = 1 THEN create_time + INTERVAL 8 YEARS ELSE create_time END"))
    headers, lines = _timed(shop)
    sources = [
        Arrivals(again(headers), f"{work}/orders", by="arrival", slices=2, positions=again(shop.order_times())),
        Arrivals(again(lines), f"{work}/lines", by="arrival", slices=2)]
    run_through(sources, lambda: sales.start_join(
        sales.join_streams(sources[0].stream(), sources[1].stream()), f"{work}/out", f"{work}/check", ONCE))
    return plain(read(shop.spark, f"{work}/out"), *WIDE)


def stream_order_split(shop: ShopTables, work: str) -> DataFrame:
    # Which line of an order comes last depends on arrival, so orders are compared as a whole.
    sources, joined = _joined_streams(shop, work)
    schema = joined().schema
    out = lambda df, batch_id: write_batch(df, f"{work}/out", batch_id)
    run_through(
        sources,
        lambda: sales.start_join(joined(), f"{work}/joined", f"{work}/check1", ONCE),
        lambda: sales.start_split(file_stream(shop.spark, f"{work}/joined", schema), [out], f"{work}/check2", ONCE),
    )
    return _by_order(plain(read(shop.spark, f"{work}/out")))


def _by_order(lines: DataFrame) -> DataFrame:
    # At most one line of an order may differ from its own rounded share.
    own = F.expr("CAST((2 * CAST(line_c AS DECIMAL(38, 0)) * final_c + orig_c) DIV (2 * orig_c) AS BIGINT)")
    return lines.groupBy("order_id").agg(
        F.count("*").alias("lines"), F.sum("line_c").alias("line_c"), F.sum("share_c").alias("share_c"),
        F.count_if(F.col("share_c") != own).alias("adjusted"),
    )


def _paid_later(shop: ShopTables, work: str) -> list[Arrivals]:
    """Orders arrive unpaid, year by year; the paid images, with their old creation time, come a year later."""
    arrival, times = F.year("create_time") - 1992, shop.order_times()
    # One pass over the orders makes both images.
    images = lambda df: df.withColumn("_paid", F.expr("explode(IF(operate_time IS NULL, array(0), array(0, 1)))")).withColumns({
        "operate_time": F.when(F.col("_paid") == 1, F.col("operate_time")), "arrival": arrival + F.col("_paid")}).drop("_paid")
    lines = shop.order_detail().join(times.drop("operate_time"), "order_id").withColumn("arrival", arrival).drop("line_number")
    return [
        Arrivals(images(shop.order_info()), f"{work}/orders", by="arrival", slices=4, positions=images(times)),
        Arrivals(lines, f"{work}/lines", by="arrival", slices=4)]


def stream_order_wide_late_paid(shop: ShopTables, work: str) -> DataFrame:
    sources = _paid_later(shop, work)
    joined = lambda: sales.join_streams(sources[0].stream(), sources[1].stream(), watermark="3000 days")
    run_through(sources, lambda: sales.start_join(joined(), f"{work}/out", f"{work}/check", ONCE))
    return plain(read(shop.spark, f"{work}/out"), *WIDE)


def stream_order_wide_late_repaired(shop: ShopTables, work: str) -> DataFrame:
    """With the default lateness the stream leaves rows out; the repair finds them in what is stored."""
    sources = _paid_later(shop, work)
    joined = lambda: sales.join_streams(sources[0].stream(), sources[1].stream())
    schema = joined().schema
    run_through(sources, lambda: sales.start_join(joined(), f"{work}/out", f"{work}/check", ONCE), keep=True)
    streamed = shop.spark.read.schema(schema).parquet(f"{work}/out")
    return plain(streamed.unionByName(_missed(sources, streamed, work)), *WIDE)


def _missed(sources: list[Arrivals], stored: DataFrame, work: str) -> DataFrame:
    """What the stream left out of the orders and lines that came in, stored, as the repair reads it four times."""
    missed = stored_table(late.missed(*(source.arrived() for source in sources), stored), f"{work}/missed")
    for source in sources:
        source.discard()
    return missed


def stream_order_split_late_repaired(shop: ShopTables, work: str) -> DataFrame:
    """Shares of the streamed lines and the repaired ones together, by order."""
    sources = _paid_later(shop, work)
    joined = lambda: sales.join_streams(sources[0].stream(), sources[1].stream())
    schema = joined().schema
    out = lambda df, batch_id: write_batch(df, f"{work}/out", batch_id)
    out(wide.finish_share(wide.with_raw_share(shop.spark.createDataFrame([], schema))).drop("operate_time"), -1)
    run_through(
        sources,
        lambda: sales.start_join(joined(), f"{work}/joined", f"{work}/check1", ONCE),
        lambda: sales.start_split(file_stream(shop.spark, f"{work}/joined", schema), [out], f"{work}/check2", ONCE),
        keep=True,
    )
    stored = read(shop.spark, f"{work}/out").drop("batch_id")
    return _by_order(plain(stored.unionByName(late.repair(_missed(sources, stored, work), stored))))


def _brand_lines(shop: ShopTables) -> DataFrame:
    return details.enrich(lines_split(shop), *products(shop)).select(
        "order_detail_id", "create_time", "tm_id", "tm_name", "final_detail_amount"
    )


def stream_brand_batch_sum(shop: ShopTables, work: str) -> DataFrame:
    """The newest batch is done again at every restart, and counts once."""
    source = Arrivals(_brand_lines(shop), f"{work}/lines", by="create_time")
    starts = [0]

    def start() -> StreamingQuery:
        if starts[0]:
            forget_commit(shop.spark, f"{work}/check")
        starts[0] += 1
        return sales.start_brand(source.stream(), f"{work}/stat", f"{work}/check", ONCE)

    run_through([source], start)
    return read(shop.spark, f"{work}/stat").groupBy("trademark_id", "trademark_name").agg(
        F.sum("amount").alias("amount_c")
    )


def stream_hour_sums(shop: ShopTables, work: str) -> DataFrame:
    lines = lines_split(shop).select("order_detail_id", "create_time", "final_detail_amount")
    source, table = Arrivals(lines, f"{work}/lines", by="create_time"), sales.hour_table(shop.spark, f"{work}/hours")
    run_through([source], lambda: sales.start_hours(source.stream(), table, f"{work}/check", ONCE))
    return table.read().select("dt", "hr", F.col("order_amount").cast("bigint").alias("order_amount"))


def stream_first_seen(shop: ShopTables, work: str) -> DataFrame:
    logs = shop.startup().select(json_column("common", "ts").alias("value"), "ts")
    source = Arrivals(logs, f"{work}/logs", by="ts")
    out = lambda df, batch_id: write_batch(df, f"{work}/out", batch_id, ("dt",))
    run_through([source], lambda: devices.start_first_seen(source.stream(), [out], f"{work}/check", ONCE))
    return read(shop.spark, f"{work}/out").select("mid", "dt")


def stream_dau_counts(shop: ShopTables, work: str) -> DataFrame:
    """Rows before and after de-duplication, added up over the log of all batches."""
    logs = shop.startup().select(json_column("common", "ts").alias("value"), "ts")
    source = Arrivals(logs, f"{work}/logs", by="ts")
    name = f"dau-{uuid.uuid4().hex[:8]}"
    log = progress.BatchLog(shop.spark, f"{work}/log", (name,)).attach()
    try:
        run_through([source], lambda: devices.start(source.stream(), f"{work}/out", f"{work}/check", ONCE, name=name))
    finally:
        log.detach()
    rows = lambda metric: F.sum(F.coalesce(F.col(f"metrics.{metric}.rows"), F.lit(0))).alias(metric)
    return progress.batches(shop.spark, f"{work}/log").agg(rows("dau_before"), rows("dau_after"))


def stream_rejected(shop: ShopTables, work: str) -> DataFrame:
    """Logs of which some cannot be used: what was accepted, and the text and reason of what was not."""
    texts = shop.startup_mixed()
    source = Arrivals(texts, f"{work}/texts", by="event_id")
    schema = "event_id bigint, common struct<mid:string>, ts bigint"
    good, bad = (lambda df, batch_id, name=name: write_batch(df, f"{work}/{name}", batch_id) for name in ("good", "bad"))
    run_through([source], lambda: start_sorted(
        sorted_rows(source.stream(), schema, key="ts", also="common.mid"), [good], [bad], f"{work}/check", ONCE))
    accepted = read(shop.spark, f"{work}/good").select(F.col("event_id").cast("string").alias("value"), F.lit("accepted").alias("reason"))
    return accepted.unionByName(read(shop.spark, f"{work}/bad").select("value", "reason"))


STREAMS: dict[str, Callable[[ShopTables, str], DataFrame]] = {
    f.__name__: f
    for f in (
        stream_dau_rows, stream_cdc_explode, stream_cdc_route, stream_dim_upsert, stream_detail_enriched,
        *map(_stream_dimension, ("user", "sku", "spu", "trademark", "category3")), stream_orders_by_day,
        stream_order_first_flag, stream_new_buyers, stream_order_wide, stream_order_wide_resent, stream_order_wide_late_paid,
        stream_order_wide_late_repaired, stream_order_split, stream_order_split_late_repaired, stream_brand_batch_sum,
        stream_hour_sums, stream_first_seen, stream_dau_counts, stream_rejected,
    )
}


def _query(name: str, build: Callable[[ShopTables, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(ShopTables(configure(spark), sf_dir), scratch_dir(spark, name))
    return run


def stream_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name, build) for name, build in STREAMS.items()}
