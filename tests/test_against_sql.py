"""Every batch query next to its check SQL, and what must hold whatever the data."""

import pytest
from small_tables import SMALL
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from tillflow.checks.queries import BATCH, batch_queries, brand_stat, devices, lines_split
from tillflow.checks.replays import stream_queries
from tillflow.operators import dau, orders
from tillflow.plans import reports
from tillflow.sources.shop import ShopTables
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def shop(spark):
    return ShopTables(spark, SMALL)


def test_every_query_has_check_sql():
    assert {*batch_queries(), *stream_queries()} <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", list(BATCH))
def test_query(spark, con, key):
    verdict, _ = compare(spark, con, SMALL, key, queries()[key], oracle_sql()[key])
    assert verdict.startswith("ok"), verdict


@pytest.mark.parametrize("key", ["stream_dau_rows", "stream_order_split", "stream_order_first_flag", "stream_order_wide_resent", "stream_order_split_late_repaired",
                                 "stream_hour_sums", "stream_rejected", "stream_dau_counts", "stream_first_seen", "stream_new_buyers"])
def test_stream(spark, con, key):
    verdict, _ = compare(spark, con, SMALL, key, queries()[key], oracle_sql()[key])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry(spark).count() == 10


def test_shares_add_up_to_the_payment(shop):
    per_order = lines_split(shop).groupBy("order_id").agg(
        F.sum("final_detail_amount").alias("s"), F.max("final_total_amount").alias("f"))
    assert (per_order.count(), per_order.where("s <> f").count()) == (991, 0)


def test_one_first_order_per_new_buyer(shop):
    flagged = orders.with_first_flag(shop.order_info(), shop.user_state())
    per_buyer = flagged.groupBy("user_id").agg(F.count_if(F.col("if_first_order") == "1").alias("n"))
    consumed = shop.user_state().where("if_consumed = '1'").select("user_id", F.lit(0).alias("want"))
    wrong = per_buyer.join(consumed, "user_id", "left").where("n <> coalesce(want, 1)")
    assert wrong.count() == 0


def test_device_rows_are_distinct_devices(shop):
    rows = devices(shop).groupBy("dt").count()
    exact = reports.dau_distinct(dau.device_rows(dau.with_day_hour(shop.startup())))
    assert rows.join(exact, "dt").where("count <> dau").count() == 0


def test_hours_and_brands_add_up_to_the_days(shop):
    lines = lines_split(shop)
    total = lines.agg(F.sum("final_detail_amount")).first()[0]
    hours = reports.order_amount_by_hour(lines, "1990-01-01", "2010-01-01")
    assert hours.agg(F.sum("order_amount")).first()[0] == total
    assert brand_stat(shop).agg(F.sum("amount")).first()[0] == total
