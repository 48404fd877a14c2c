"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tillflow.checks.oracle import AS_OF, DAU_DAY, DAU_DAY_BEFORE, DAY, DAY_BEFORE, RANGE, TOP_N
from tillflow.functions import age_group, gender_label
from tillflow.operators import brand, cdc, dau, details, dims, orders, wide
from tillflow.operators.parsing import typed_rows
from tillflow.plans import reports
from tillflow.session import configure, scratch_dir
from tillflow.sinks.folders import delete, versions
from tillflow.sinks.tables import pack_days, read_days
from tillflow.sources.shop import Days, ShopTables

Query = Callable[[SparkSession, str], DataFrame]

CENTS = {
    "final_total_amount": "final_c",
    "original_total_amount": "orig_c",
    "final_detail_amount": "share_c",
    "order_price": "price_c",
}
ORDER_COLUMNS = (
    "id", "province_id", "order_status", "user_id", "final_c", "orig_c", "create_time", "operate_time",
)
SPLIT_COLUMNS = ("order_detail_id", "order_id", "line_c", "orig_c", "final_c", "share_c")
WIDE_COLUMNS = (
    "order_detail_id", "order_id", "user_id", "sku_id", "sku_num", "line_c", "orig_c", "final_c",
    "dt", "create_time",
)
PRODUCT_KEYS = ("tm_id", "tm_name", "spu_id", "category3_id")


def as_of():
    return F.lit(AS_OF).cast("date")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Short cents names, and times without zone as in the driver's tables."""
    df = df.withColumnsRenamed(CENTS)
    if "sku_price" in df.columns:
        df = df.withColumn("line_c", F.col("sku_price") * F.col("sku_num"))
    times = {n: F.col(n).cast("timestamp_ntz") for n, t in df.dtypes if t == "timestamp"}
    df = df.withColumns(times) if times else df
    return df.select(*columns) if columns else df


def products(shop: ShopTables) -> tuple[DataFrame, ...]:
    return shop.sku(), shop.spu(), shop.trademark(), shop.category3()


def lines_split(shop: ShopTables, days: Days = None, residual: str = "last") -> DataFrame:
    """Wide rows with shares.  Line ids of the tables are unique already."""
    joined = wide.join_wide(shop.order_info(days), shop.order_detail())
    return wide.apportion(joined, residual)


def brand_stat(shop: ShopTables, days: Days = None) -> DataFrame:
    """Brand sums with one batch per day.

    Products are joined once the shares are known, so the wide rows carry no
    product columns through the exchanges.
    """
    lines = details.enrich(lines_split(shop, days), *products(shop))
    return brand.brand_sums(lines, F.col("dt").cast("timestamp"), by=("dt",))


_STORED: dict[tuple, tuple[str, StructType]] = {}


def stored(shop: ShopTables, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Days of a table that reports read: written once per session and state of the folder of tables."""
    spark = shop.spark
    key = (spark.sparkContext.applicationId, shop.folder, versions(spark, shop.folder), name)
    if key not in _STORED:
        path = scratch_dir(spark, name)
        STORED[name](shop).write.parquet(f"{path}/staged")
        staged = spark.read.parquet(f"{path}/staged")
        pack_days(staged, f"{path}/packs")
        _STORED[key] = f"{path}/packs", staged.schema
        delete(spark, f"{path}/staged")
    return read_days(spark, *_STORED[key], first, last)


# What is kept by day: the wide table with shares, as its stream leaves it behind, brand sums, and first days of devices.
STORED: dict[str, Callable[[ShopTables], DataFrame]] = {
    "order-wide": lambda s: lines_split(s).select("order_detail_id", "order_id", "create_time", "final_detail_amount", "dt"),
    "brand-stat": lambda s: brand_stat(s).withColumn("dt", F.to_date("stat_time")),
    "first-seen": lambda s: device_logs(s).groupBy("mid").agg(F.min("dt").alias("dt")),
}


def build_stored(spark: SparkSession, folder: str, name: str) -> None:
    """Write a stored table if it is not there, for timing it by itself."""
    stored(ShopTables(configure(spark), folder), name)


def sales(shop: ShopTables, first: str, last: str | None = None) -> DataFrame:
    return stored(shop, "order-wide", first, last)


def device_logs(shop: ShopTables, days: Days = None) -> DataFrame:
    """All device rows, repeated ones included."""
    return dau.device_rows(dau.with_day_hour(shop.startup(days)))


def devices(shop: ShopTables, days: Days = None) -> DataFrame:
    return dau.daily_devices(shop.startup(days), tie_break=("event_id",))


def enriched_orders(shop: ShopTables) -> DataFrame:
    return orders.enrich(
        shop.order_info(), shop.user_state(), shop.province(), shop.users(), as_of()
    )


def order_wide(shop: ShopTables) -> DataFrame:
    return wide.join_wide(shop.order_info(), shop.order_detail())


def order_wide_dedup(shop: ShopTables) -> DataFrame:
    lines = shop.order_detail()
    return wide.join_once(shop.order_info(), lines.unionByName(lines))


def order_wide_table(shop: ShopTables) -> DataFrame:
    table = wide.wide_table(
        enriched_orders(shop), shop.order_detail(), plain_orders=shop.order_info()
    )
    return plain(
        details.enrich(table, *products(shop)),
        "order_detail_id", "order_id", "order_status", "create_time", "user_id", "sku_id", "sku_num",
        "final_c", "share_c", "if_first_order", "province_name", "province_area_code",
        "user_age_group", "user_gender", "dt", "spu_id", "tm_id", "category3_id",
        "spu_name", "tm_name", "category3_name",
    )


def json_parse(shop: ShopTables) -> DataFrame:
    schema = "event_id bigint, common struct<mid:string,uid:string,ar:string,ch:string,vc:string>, ts bigint"
    rows = typed_rows(shop.startup_json(), schema, key="ts")
    return rows.select("event_id", "common.mid", "common.uid", "common.ar", "common.ch", "common.vc", "ts")


def cdc_images(routed: DataFrame) -> DataFrame:
    """Routed images with the fields of the image, for comparison."""
    return routed.select(
        "topic",
        F.get_json_object("value", "$.id").alias("id"),
        F.get_json_object("value", "$.name").alias("name"),
    )


def dim_upsert(shop: ShopTables) -> DataFrame:
    stored = shop.province().withColumn("seq", F.lit(1))
    return dims.upsert(stored, shop.province_renames(), "id", "seq").drop("seq")


def order_split_incomplete(shop: ShopTables) -> DataFrame:
    """Every seventh order still waits for a line: its original total is above the sum of its lines."""
    waiting = F.when(F.col("id") % 7 == 0, F.col("original_total_amount") + 100).otherwise(F.col("original_total_amount"))
    headers = shop.order_info().withColumn("original_total_amount", waiting)
    return plain(wide.apportion(wide.join_wide(headers, shop.order_detail())), *SPLIT_COLUMNS)


def user_labels(shop: ShopTables) -> DataFrame:
    """Label functions on the dimension itself."""
    return shop.users().select(
        "id",
        age_group(F.col("birthday"), as_of()).alias("user_age_group"),
        gender_label(F.col("gender")).alias("user_gender"),
    )


def topn(shop: ShopTables) -> DataFrame:
    return brand.brand_topn(stored(shop, "brand-stat", RANGE[0][:10], RANGE[1][:10]), *RANGE, TOP_N)


BATCH: dict[str, Callable[[ShopTables], DataFrame]] = {
    "json_parse": json_parse,
    "event_date_hour": lambda s: dau.with_day_hour(s.startup()).select("event_id", "dt", "hr"),
    "order_date_hour": lambda s: orders.with_day_hour(s.order_info()).select(
        "id", "create_date", "create_hour"),
    "orders_operated": lambda s: plain(orders.operated(s.order_info()), *ORDER_COLUMNS),
    "dim_scan": lambda s: dims.scan(s.province(), "province"),
    "dim_scan_user": lambda s: dims.scan(s.users(), "user"),
    "dim_scan_sku": lambda s: dims.scan(s.sku(), "sku"),
    "dim_scan_spu": lambda s: dims.scan(s.spu(), "spu"),
    "dim_scan_trademark": lambda s: dims.scan(s.trademark(), "trademark"),
    "dim_scan_category3": lambda s: dims.scan(s.category3(), "category3"),
    "dim_upsert": dim_upsert,
    "state_lookup_semi": lambda s: dims.lookup(s.user_state(), s.order_info(), "user_id"),
    "cdc_explode": lambda s: cdc_images(cdc.explode_images(s.cdc_array())),
    "cdc_route": lambda s: cdc_images(cdc.route_image(s.cdc_object())),
    "order_with_province": lambda s: orders.with_province(s.order_info(), s.province()).select(
        "id", "province_id", "province_name", "province_area_code", "province_iso_code"),
    "order_with_user": lambda s: orders.with_user(s.order_info(), s.users(), as_of()).select(
        "id", "user_id", "user_age_group", "user_gender"),
    "user_age_group": lambda s: user_labels(s).select("id", "user_age_group"),
    "user_gender": lambda s: user_labels(s).select("id", "user_gender"),
    "order_first_flag_raw": lambda s: orders.with_consumed_flag(s.order_info(), s.user_state()).select(
        "id", "user_id", "if_first_order"),
    "order_first_flag": lambda s: orders.with_first_flag(s.order_info(), s.user_state()).select(
        "id", "user_id", "if_first_order"),
    "new_consumed_users": lambda s: orders.new_consumed_users(
        orders.with_first_flag(s.order_info(), s.user_state())),
    "enriched_orders": lambda s: plain(
        enriched_orders(s), *ORDER_COLUMNS, "create_date", "create_hour", "if_first_order", "province_name",
        "province_area_code", "province_iso_code", "user_age_group", "user_gender"),
    "detail_with_sku": lambda s: details.with_sku(s.order_detail(), s.sku()).select(
        "id", "order_id", "sku_id", "spu_id", "tm_id", "category3_id"),
    "detail_enriched": lambda s: plain(
        details.enrich(s.order_detail(), *products(s)), "id", "order_id", "sku_id", "sku_num", "price_c",
        "spu_id", "tm_id", "category3_id", "spu_name", "tm_name", "category3_name"),
    "order_wide": lambda s: plain(
        details.enrich(order_wide(s), *products(s)), *WIDE_COLUMNS, *PRODUCT_KEYS),
    "order_wide_dedup": lambda s: plain(
        details.enrich(order_wide_dedup(s), *products(s)), *WIDE_COLUMNS, *PRODUCT_KEYS),
    "order_split_amount": lambda s: plain(lines_split(s), *SPLIT_COLUMNS),
    "order_split_no_residual": lambda s: plain(lines_split(s, residual="none"), *SPLIT_COLUMNS),
    "order_split_incomplete": order_split_incomplete,
    "order_wide_table": order_wide_table,
    "brand_batch_sum": lambda s: plain(brand_stat(s)).withColumnRenamed("amount", "amount_c"),
    "brand_topn": topn,
    "brand_chart": lambda s: brand.brand_chart(topn(s)),
    "order_amount_total": lambda s: reports.order_amount_total(sales(s, DAY), DAY),
    "order_amount_by_hour": lambda s: reports.order_amount_by_hour(sales(s, DAY), DAY),
    "hour_map": lambda s: reports.hour_map(
        reports.order_amount_by_hour(sales(s, DAY), DAY), "order_amount"
    ).select("dt", F.to_json("hours").alias("hours")),
    "dau_rows": devices,
    "dau_distinct_check": lambda s: reports.dau_distinct(device_logs(s)),
    "dau_total": lambda s: reports.dau_total(devices(s, (DAU_DAY, DAU_DAY)), DAU_DAY),
    "dau_by_hour": lambda s: reports.dau_by_hour(devices(s, (DAU_DAY, DAU_DAY)), DAU_DAY),
    "report_day_total": lambda s: reports.day_headline(
        device_logs(s, (DAU_DAY, DAU_DAY)), sales(s, DAY), DAU_DAY, sales_day=DAY,
        first_seen=stored(s, "first-seen", DAU_DAY)),
    "report_hour_dau": lambda s: reports.hour_curve(
        "dau", devices(s, (DAU_DAY_BEFORE, DAU_DAY)), DAU_DAY),
    "report_hour_amount": lambda s: reports.hour_curve(
        "order_amount", sales(s, DAY_BEFORE, DAY), DAY),
}


def _query(build: Callable[[ShopTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(ShopTables(configure(spark), sf_dir))
    return run


def batch_queries() -> dict[str, Query]:
    return {key: _query(build) for key, build in BATCH.items()}
