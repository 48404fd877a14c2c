"""The driver's star-schema tables in the shape of the shop's entities.

Amounts are whole cents (bigint), which every engine adds up alike.  A ``days``
argument narrows the orders (or logs) to whole days already at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillflow.functions import day_between
from tillflow.operators.parsing import json_column
from tillflow.sources.files import table

Days = tuple[str, str] | None

# Declared, so that no job has to open files to learn them.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _cents(name: str) -> str:
    return f"CAST(round({name} * 100) AS BIGINT)"


def _order_time(later: str = "") -> str:
    return f"CAST(o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 86400{later}) AS TIMESTAMP)"


ORDER_TIMES = (
    f"{_order_time()} AS create_time",
    f"CASE WHEN o_orderstatus <> 'P' THEN {_order_time(' + 3600')} END AS operate_time",
)


class ShopTables:
    """Entity views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, f"{self.folder}/{name}.parquet", schema=TABLES[name])

    # -- logs ---------------------------------------------------------------
    def startup(self, days: Days = None) -> DataFrame:
        """Start-up logs: ``common`` struct, ``ts`` in epoch milliseconds, ``event_id``."""
        events = self.raw("events")
        if days:
            events = events.where(day_between(F.col("ts"), *days))
        return events.selectExpr(
            "event_id",
            """named_struct('mid', concat('mid_', user_id), 'uid', CAST(user_id AS STRING),
                            'ar', get_json_object(props, '$.k'), 'ch', event_type, 'vc', 'v1') AS common""",
            "unix_millis(CAST(ts AS TIMESTAMP)) AS ts",
        )

    def startup_json(self) -> DataFrame:
        """The same logs as JSON text in ``value``."""
        return self.startup().select(json_column("event_id", "common", "ts").alias("value"))

    def startup_mixed(self) -> DataFrame:
        """Logs of which some are broken, lack their time or their device, or have a time that is none."""
        ts, mid, last = "unix_millis(CAST(ts AS TIMESTAMP))", "concat('mid_', user_id)", "concat(',\"event_id\":', event_id, '}')"
        device = f"concat('{{\"common\":{{\"mid\":\"', {mid}, '\"}}')"
        return self.raw("events").selectExpr("event_id", f"""
            CASE event_id % 7 WHEN 0 THEN concat('broken ', event_id) WHEN 1 THEN concat({device}, {last})
            WHEN 2 THEN concat('{{\"ts\":', {ts}, {last}) WHEN 3 THEN concat({device}, ',\"ts\":\"late\"', {last})
            ELSE concat({device}, ',\"ts\":', {ts}, {last}) END AS value""")

    # -- dimensions ---------------------------------------------------------
    def province(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) AS id", "n_name AS name",
            "CAST(100 + n_regionkey AS STRING) AS area_code", "concat('N', n_nationkey) AS iso_code",
        )

    def province_changes(self) -> DataFrame:
        """A change log: every region once, some of them renamed by a second change."""
        first = self.province()
        renamed = first.where(F.col("id") % 5 == 0).withColumn("name", F.concat("name", F.lit("_v2")))
        return first.withColumn("seq", F.lit(1)).unionByName(renamed.withColumn("seq", F.lit(2)))

    def province_renames(self) -> DataFrame:
        """Later changes to the stored regions, and one region that is not stored yet."""
        new = self.spark.range(1).selectExpr("CAST(-1 AS BIGINT) AS id", "'new' AS name", "'0' AS area_code", "'N' AS iso_code")
        return self.province_changes().where("seq = 2").unionByName(new.withColumn("seq", F.lit(2)))

    def users(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id",
            "date_add(DATE'1950-01-01', CAST(c_custkey * 37 % 25000 AS INT)) AS birthday",
            "CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'X' END AS gender",
        )

    def user_state(self) -> DataFrame:
        """All buyers; one customer key in ten is known to have ordered before."""
        return self.raw("customer").selectExpr(
            "c_custkey AS user_id", "CASE WHEN c_custkey % 10 = 0 THEN '1' ELSE '0' END AS if_consumed"
        )

    def spu(self) -> DataFrame:
        return self.raw("part").groupBy(F.col("p_name").alias("spu_name")).agg(F.min("p_partkey").alias("spu_id"))

    def trademark(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS tm_id", "p_brand AS tm_name"
        ).distinct()

    def category3(self) -> DataFrame:
        return self.raw("part").groupBy(F.col("p_type").alias("category3_name")).agg(
            F.min("p_partkey").alias("category3_id")
        )

    def sku(self) -> DataFrame:
        return (
            self.raw("part")
            .join(self.spu(), F.col("p_name") == F.col("spu_name"))
            .join(self.trademark(), F.col("p_brand") == F.col("tm_name"))
            .join(self.category3(), F.col("p_type") == F.col("category3_name"))
            .select(F.col("p_partkey").alias("sku_id"), "spu_id", "tm_id", "category3_id")
        )

    # -- facts --------------------------------------------------------------
    def order_detail(self) -> DataFrame:
        quantity, price = "CAST(l_quantity AS BIGINT)", _cents("l_extendedprice")
        return self.raw("lineitem").selectExpr(
            f"concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {quantity}, {price}) AS id",
            "l_orderkey AS order_id",
            "l_partkey AS sku_id",
            f"{price} AS order_price",
            f"{quantity} AS sku_num",
            "concat('sku_', l_partkey) AS sku_name",
            "l_linenumber AS line_number",
        )

    def order_info(self, days: Days = None) -> DataFrame:
        """Order headers; the original total is the sum of the order's lines."""
        orders = self.raw("orders")
        lines = self.order_detail()
        if days:
            orders = orders.where(day_between(F.col("o_orderdate"), *days))
            lines = lines.join(orders.select(F.col("o_orderkey").alias("order_id")), "order_id", "left_semi")
        original = lines.groupBy(F.col("order_id").alias("o_orderkey")).agg(
            F.expr("sum(order_price * sku_num) AS original_total_amount")
        )
        return (
            # By the order last: what joins lines to it, or groups by it, finds it in place.
            orders.join(self._order_customers(), "o_custkey").join(original, "o_orderkey", "left")
            .selectExpr(
                "o_orderkey AS id",
                "province_id",
                "o_orderstatus AS order_status",
                "o_custkey AS user_id",
                f"{_cents('o_totalprice')} AS final_total_amount",
                "CAST(NULL AS BIGINT) AS benefit_reduce_amount",
                "original_total_amount",
                "CAST(NULL AS BIGINT) AS feight_fee",
                "CAST(NULL AS TIMESTAMP) AS expire_time",
                *ORDER_TIMES,
            )
        )

    def order_times(self) -> DataFrame:
        """``order_id`` and times of the order headers, without their totals: the lines are not read for it."""
        return self.raw("orders").join(self._order_customers(), "o_custkey").selectExpr("o_orderkey AS order_id", *ORDER_TIMES)

    def _order_customers(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey AS o_custkey", "CAST(c_nationkey AS BIGINT) AS province_id")

    # -- change records -----------------------------------------------------
    def cdc_rows(self) -> DataFrame:
        """(table, id, name) of the regions, the buyers and the products."""
        regions = self.province().selectExpr("'base_province' AS table", "id", "name")
        buyers = self.raw("customer").selectExpr("'user_info' AS table", "c_custkey AS id", "c_name AS name")
        products = self.raw("part").selectExpr("'sku_info' AS table", "p_partkey AS id", "p_name AS name")
        return regions.unionByName(buyers).unionByName(products)

    def cdc_object(self) -> DataFrame:
        """One envelope per row."""
        image = F.struct(F.col("id").cast("string").alias("id"), "name")
        return self.cdc_rows().select(json_column("table", image.alias("data")).alias("value"))

    def cdc_array(self) -> DataFrame:
        """Envelopes of a table's rows, at most a hundred in each."""
        image = F.struct(F.col("id").cast("string").alias("id"), "name")
        return self.cdc_rows().groupBy("table", F.expr("id DIV 100")).agg(F.collect_list(image).alias("images")).select(
            json_column("table", F.col("images").alias("data")).alias("value")
        )
