import datetime as dt
import random
from decimal import Decimal as D

import pytest

from tillflow.operators import brand, details, wide
from pyspark.sql import functions as F

LINE = ("order_detail_id bigint, order_id bigint, sku_price {m}, sku_num bigint, "
        "final_total_amount {m}, original_total_amount {m}")
DEC, CENT = LINE.format(m="decimal(16,2)"), LINE.format(m="bigint")


def shares(df):
    return {r.order_detail_id: r.final_detail_amount for r in df.collect()}


def test_last_line_gets_what_is_left(spark):
    df = spark.createDataFrame([(i, 1, D("40.00"), 1, D("100.00"), D("120.00")) for i in (1, 2, 3)], DEC)
    assert shares(wide.apportion(df)) == {1: D("33.33"), 2: D("33.33"), 3: D("33.34")}
    assert shares(wide.apportion(df, residual="none")) == dict.fromkeys((1, 2, 3), D("33.33"))


def test_single_line(spark):
    df = spark.createDataFrame([(1, 1, D("40.00"), 1, D("33.50"), D("40.00"))], DEC)
    assert shares(wide.apportion(df)) == {1: D("33.50")}


def test_zero_original(spark):
    df = spark.createDataFrame([(1, 1, 0, 1, 500, 0), (2, 1, 0, 1, 500, 0)], CENT)
    assert shares(wide.apportion(df)) == {1: None, 2: 500}


def test_unknown_residual_is_refused(spark):
    with pytest.raises(ValueError):
        wide.apportion(spark.createDataFrame([], CENT), residual="first")


def test_shares_always_add_up(spark):
    rng, data, line = random.Random(3), [], 0
    for order in range(200):
        prices = [(rng.randrange(1, 9999), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 9))]
        original, final = sum(p * n for p, n in prices), rng.randrange(0, 99999)
        for price, num in prices:
            line += 1
            data.append((line, order, price, num, final, original))
    got = wide.apportion(spark.createDataFrame(data, CENT)).groupBy("order_id").agg(
        F.sum("final_detail_amount").alias("s"), F.max("final_total_amount").alias("f"))
    assert got.count() == 200 and got.where("s <> f").count() == 0


def header(spark, *data):
    return spark.createDataFrame(
        list(data), "id bigint, create_time timestamp, operate_time timestamp, final_total_amount bigint, "
                    "original_total_amount bigint")


def test_join_and_dedup_keep_the_earliest_image(spark):
    t = dt.datetime(2024, 5, 1, 23, 59, 58)
    later = t + dt.timedelta(seconds=10)
    orders = header(spark, (1, t, later, 20, 20), (1, t, t, 10, 10), (2, t, None, 5, 5))
    lines = spark.createDataFrame([(1, 1, 7, 10, 1), (2, 2, 7, 10, 1)],
                                  "id bigint, order_id bigint, sku_id bigint, order_price bigint, sku_num bigint")
    joined = wide.join_wide(orders, lines)
    assert joined.count() == 2  # two images of order 1; order 2 was never operated on
    one = wide.dedup_wide(joined).collect()
    assert [(r.order_detail_id, r.final_total_amount, r.dt) for r in one] == [(1, 10, dt.date(2024, 5, 1))]
    for plain in (None, orders):
        table = wide.wide_table(orders, lines, plain_orders=plain).collect()
        assert [(r.order_detail_id, r.final_detail_amount) for r in table] == [(1, 10)]


def products(spark):
    return (
        spark.createDataFrame([(1, 10, 20, 30), (2, 10, 99, None)],
                              "sku_id bigint, spu_id bigint, tm_id bigint, category3_id bigint"),
        spark.createDataFrame([(10, "spu")], "spu_id bigint, spu_name string"),
        spark.createDataFrame([(20, "a:b")], "tm_id bigint, tm_name string"),
        spark.createDataFrame([(30, "cat")], "category3_id bigint, category3_name string"),
    )


def test_missing_product_or_brand_keeps_the_line(spark):
    lines = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id bigint, sku_id bigint")
    got = {r.id: (r.spu_name, r.tm_id, r.tm_name, r.category3_name)
           for r in details.enrich(lines, *products(spark)).collect()}
    assert got == {1: ("spu", 20, "a:b", "cat"), 2: ("spu", 99, None, None), 3: (None, None, None, None)}
    keys = {r.id: r.tm_id for r in details.with_sku(lines, products(spark)[0]).collect()}
    assert keys == {1: 20, 2: 99, 3: None}


def test_brand_names_stay_whole_and_sums_agree(spark):
    lines = spark.createDataFrame([(1, "a:b", 10), (1, "a:b", 5), (2, "", 7), (None, None, 1)],
                                  "tm_id bigint, tm_name string, final_detail_amount bigint")
    stat = brand.brand_sums(lines, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {(r.trademark_id, r.trademark_name): r.amount for r in stat.collect()}
    assert got == {(1, "a:b"): 15, (2, ""): 7, (None, None): 1}


def test_topn_order_ties_and_open_range(spark):
    at = lambda day: dt.datetime(2024, 1, day)
    stat = spark.createDataFrame(
        [(at(1), 9, "edge", 99), (at(5), 9, "edge", 99), (at(2), 3, "c", 5), (at(3), 1, "a", 5),
         (at(2), 2, "b", 2), (at(4), 2, "b", 4)],
        "stat_time timestamp, trademark_id bigint, trademark_name string, amount bigint")
    top = brand.brand_topn(stat, "2024-01-01 00:00:00", "2024-01-05 00:00:00", 2)
    assert [(r.trademark_id, r.order_amount) for r in top.collect()] == [(2, 6), (1, 5)]
    chart = brand.brand_chart(top).collect()
    assert [(r.x, r.y, r.s) for r in chart] == [("b", 6, 1), ("a", 5, 1)]
