"""Plans that have to hold at any size, and one order, buyer or device with a third of all rows."""

import contextlib
import re

import pytest
from small_tables import SMALL
from pyspark.sql import functions as F

from tillflow.checks.queries import BATCH
from tillflow.operators import dau, orders, wide
from tillflow.plans import reports
from tillflow.sources.files import table
from tillflow.sources.shop import TABLES, ShopTables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def conf(spark, **settings):
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def shop(spark):
    return ShopTables(spark, SMALL)


@pytest.mark.parametrize("key", list(BATCH))
def test_no_cross_joins_and_no_python(shop, key):
    text = plan(BATCH[key](shop))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("key", ["dau_rows", "order_first_flag", "order_wide_dedup", "dim_upsert"])
def test_ranks_are_cut_before_the_exchange(shop, key):
    assert re.search(r"WindowGroupLimit .* Partial", plan(BATCH[key](shop)))


def test_days_reach_the_scan(shop):
    text = plan(BATCH["dau_total"](shop))
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00" in text and "LessThan(ts,2024-01-03T00:00" in text
    assert "value:double" not in text.split("ReadSchema")[1]
    # Reports on sales read their stored tables, and of these the days they need.
    for key in ("order_amount_total", "order_amount_by_hour", "hour_map", "report_hour_amount", "report_day_total", "brand_topn", "brand_chart"):
        text = plan(BATCH[key](shop))
        assert re.search(r"PartitionFilters: \[isnotnull\(pack#\d+\), .*pack#\d+ >?=+ 199", text), key
        assert re.search(r"PushedFilters: \[IsNotNull\(dt\), .*\(dt,1997-0", text), key
        assert "lineitem" not in text, key


@pytest.mark.parametrize("key", ["json_parse", "cdc_explode", "cdc_route"])
def test_text_is_parsed_once(shop, key):
    assert plan(BATCH[key](shop)).count("from_json(") == 1


def test_topn_is_not_a_full_sort(shop):
    assert "TakeOrderedAndProject" in plan(BATCH["brand_topn"](shop))


def test_day_tables_are_pruned(spark, shop, tmp_path):
    lines = wide.apportion(wide.join_wide(shop.order_info(), shop.order_detail())).drop("operate_time")
    path = str(tmp_path / "wide")
    lines.where("dt >= '1997-01-01' and dt < '1997-03-01'").write.partitionBy("dt").parquet(path)
    text = plan(reports.order_amount_total(table(spark, path), "1997-02-01"))
    assert re.search(r"PartitionFilters: \[isnotnull\(dt.*1997-02-01", text)
    assert re.search(r"ReadSchema: struct<final_detail_amount:bigint>", text)


def shuffled(spark):
    """No broadcasts, so that small data takes the plans of large data."""
    return conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
                spark__sql__shuffle__partitions="16", spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
                spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128k",
                spark__sql__adaptive__skewJoin__skewedPartitionFactor="2")


def skewed_lines(spark, tmp_path, n=200_000):
    """Lines of which one order holds a third; as files, so that there are several map tasks."""
    hot = F.col("n") % 3 == 0
    lines = spark.range(0, n, 1, 8).withColumnRenamed("id", "n").select(
        F.col("n").alias("id"),
        F.when(hot, F.lit(1)).otherwise(F.col("n") + 10).alias("order_id"),
        F.col("n").alias("sku_id"),
        (F.col("n") % 97 + 1).alias("order_price"),
        F.lit(1).cast("bigint").alias("sku_num"),
        F.concat(F.lit("some product "), F.sha2(F.col("n").cast("string"), 256)).alias("sku_name"),
    )
    path = str(tmp_path / "lines")
    lines.write.parquet(path)
    return spark.read.parquet(path)


def headers_for(lines):
    now = F.lit("2024-05-01 10:00:00").cast("timestamp")
    return lines.groupBy("order_id").agg(F.sum(F.col("order_price") * F.col("sku_num")).alias("original_total_amount")).select(
        F.col("order_id").alias("id"), "original_total_amount",
        (F.col("original_total_amount") * 2 + 1).alias("final_total_amount"),
        now.alias("create_time"), now.alias("operate_time"))


def test_hot_order_is_split_and_adds_up(spark, tmp_path):
    lines = skewed_lines(spark, tmp_path)
    headers_path = str(tmp_path / "headers")
    headers_for(lines).repartition(4).write.parquet(headers_path)
    headers = spark.read.parquet(headers_path)
    with shuffled(spark):
        joined = wide.join_wide(headers, lines)
        joined.write.format("noop").mode("overwrite").save()
        df = wide.wide_table(headers, lines)
        df.cache().count()
        per_order = df.groupBy("order_id").agg(
            F.count("*").alias("n"), F.sum("final_detail_amount").alias("s"), F.max("final_total_amount").alias("f"))
        assert per_order.where("s <> f").count() == 0
        assert per_order.agg(F.sum("n"), F.max("n")).first()[:] == (200_000, 66_667)
        df.unpersist()
        checked = wide.join_wide(headers, lines)
        checked.collect()
        text = plan(checked)
    assert "isFinalPlan=true" in text and "skew=true" in text


def test_wide_rows_are_not_exchanged_for_the_split(spark, tmp_path):
    """What is left for the last line is joined by the order, where the rows lie already."""
    lines = skewed_lines(spark, tmp_path).where("order_id <> 1")
    path = str(tmp_path / "headers")
    headers_for(lines).write.parquet(path)
    with shuffled(spark):
        df = wide.apportion(wide.join_wide(spark.read.parquet(path), lines))
        text = plan(df)
    assert "hashpartitioning(order_id" in text and "hashpartitioning(order_detail_id" not in text


def test_headers_lie_by_order_when_lines_are_joined(spark, tmp_path):
    """Buyers are joined before the totals, so the headers are not exchanged by order once more."""
    for name in ("customer", "orders", "lineitem"):
        spark.createDataFrame([], TABLES[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    shop = ShopTables(spark, str(tmp_path))
    with shuffled(spark):
        text = plan(wide.join_once(shop.order_info(), shop.order_detail()))
    # Orders by buyer and by order, buyers, totals, lines by their id and by order.
    assert len(re.findall(r"Exchange hashpartitioning\(", text)) == 6


def test_left_over_goes_to_the_line_of_its_own_order(spark):
    """Line ids that two orders share, and a line that was sent twice."""
    rows = spark.createDataFrame(
        [(1, 9, 50, 1, 99, 100), (1, 5, 50, 1, 99, 100), (2, 9, 30, 1, 31, 30), (3, 7, 1, 1, 10, 9)],
        "order_id bigint, order_detail_id bigint, sku_price bigint, sku_num bigint, final_total_amount bigint, original_total_amount bigint")
    got = sorted((r.order_id, r.order_detail_id, r.final_detail_amount) for r in wide.apportion(rows).collect())
    assert got == [(1, 5, 50), (1, 9, 49), (2, 9, 31), (3, 7, 1)]


def test_hot_buyer(spark):
    hot = spark.range(0, 90_000, 1, 6).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100).alias("user_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id")).alias("create_time"))
    state = spark.createDataFrame([(101, "1")], "user_id bigint, if_consumed string")
    with shuffled(spark):
        got = orders.with_first_flag(hot, state)
        assert got.where("if_first_order = '1'").agg(F.count("*")).first()[0] == 60_000
        assert got.where("user_id = 7 and if_first_order = '1'").first().id == 89_997
        # One row per buyer and map task goes through the exchange, not every order of the buyer.
        assert re.search(r"Exchange hashpartitioning\(user_id.*\n.*WindowGroupLimit .* Partial", plan(got))


def test_hot_device(spark):
    rows = spark.range(0, 60_000, 1, 6).select(
        F.struct(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("mid"),
                 *(F.lit("x").alias(c) for c in ("uid", "ar", "ch", "vc"))).alias("common"),
        (F.lit(1_700_000_000_000) + F.col("id")).alias("ts"))
    got = dau.daily_devices(rows)
    assert got.count() == 40_001
    assert got.where("mid = 'hot'").first().ts == 1_700_000_000_000
