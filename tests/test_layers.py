"""All layers in a row, JSON to brand sums, in two rounds with a restart of every query."""

import datetime as dt
import json
from decimal import Decimal as D

import pytest

from tillflow.plans import reports
from tillflow.sinks.outputs import to_messages, to_table
from tillflow.sources.files import file_stream
from tillflow.streaming import changes, sales
from tillflow.streaming.running import ONCE


def envelope(table, *images):
    return (json.dumps({"table": table, "type": "insert", "data": [{k: str(v) for k, v in i.items()} for i in images]}),)


def order(key, user, final, original, create, operate):
    return {"id": key, "user_id": user, "province_id": 1, "order_status": "1002", "final_total_amount": final,
            "original_total_amount": original, "create_time": create, "operate_time": operate}


def line(key, order_id, price, create, sku=1):
    return {"id": key, "order_id": order_id, "sku_id": sku, "order_price": price, "sku_num": 1, "sku_name": "s",
            "create_time": create}


ROUNDS = [
    [envelope("order_info", order(1, 7, "100.00", "120.00", "2024-05-01 10:00:00", "2024-05-01 10:00:05")),
     envelope("order_detail", line(1, 1, "40.00", "2024-05-01 10:00:01"), line(2, 1, "40.00", "2024-05-01 10:00:01"),
              line(3, 1, "40.00", "2024-05-01 10:00:02", sku=2))],
    [envelope("order_info", order(2, 7, "7.00", "7.00", "2024-05-01 11:00:00", "2024-05-01 11:00:05")),
     envelope("order_detail", line(4, 2, "7.00", "2024-05-01 11:00:01", sku=99))],
]


def test_json_to_brand_sums(spark, tmp_path, rows):
    at = lambda *names: str(tmp_path.joinpath(*names))
    text = lambda path: file_stream(spark, path, "value string")
    dims = {
        "province": spark.createDataFrame([(1, "north", "01", "N")], "id bigint, name string, area_code string, iso_code string"),
        "users": spark.createDataFrame([(7, "1990-01-01", "M")], "id bigint, birthday string, gender string"),
    }
    products = lambda: (
        spark.createDataFrame([(1, 10, 20, 30), (2, 10, 21, 30)], "sku_id bigint, spu_id bigint, tm_id bigint, category3_id bigint"),
        spark.createDataFrame([(10, "spu")], "spu_id bigint, spu_name string"),
        spark.createDataFrame([(20, "a:b"), (21, "c")], "tm_id bigint, tm_name string"),
        spark.createDataFrame([(30, "cat")], "category3_id bigint, category3_name string"),
    )
    def joined():
        return sales.join_streams(sales.parse(text(at("dwd_order", "batch_id=*")), "enriched_order"),
                                  sales.parse(text(at("dwd_detail", "batch_id=*")), "enriched_detail"))

    steps = [
        lambda: changes.start_split_files(text(at("cdc")), "array", at("ods"), at("c0"), ONCE),
        lambda: sales.start_orders(
            sales.parse(text(at("ods", "topic=ODS_ORDER_INFO")), "order"), None, lambda: dims["province"],
            lambda: dims["users"], [to_messages(at("dwd_order"), "id"), to_table(at("orders"), "create_date")], at("c1"), ONCE),
        lambda: sales.start_details(
            sales.parse(text(at("ods", "topic=ODS_ORDER_DETAIL")), "detail"), products,
            [to_messages(at("dwd_detail"), "id")], at("c2"), ONCE),
        lambda: sales.start_join(joined(), at("joined"), at("c3"), ONCE),
        lambda: sales.start_split(
            file_stream(spark, at("joined"), joined().schema), [to_messages(at("dws"), "order_id"), to_table(at("wide"), "dt")], at("c4"), ONCE),
        lambda: sales.start_brand(sales.parse(text(at("dws", "batch_id=*")), "wide"), at("stat"), at("c5"), ONCE),
    ]
    for messages in ROUNDS:
        spark.createDataFrame(messages, "value string").write.mode("append").parquet(at("cdc"))
        for start in steps:
            start().awaitTermination()

    orders = spark.read.parquet(at("orders"))
    assert rows(orders, "id", "if_first_order", "province_name", "user_gender", "create_hour") == [
        (1, "1", "north", "男", 10), (2, "0", "north", "男", 11)]
    wide = spark.read.parquet(at("wide"))
    assert rows(wide, "order_detail_id", "final_detail_amount", "tm_name", "spu_name") == [
        (1, D("33.33"), "a:b", "spu"), (2, D("33.33"), "a:b", "spu"), (3, D("33.34"), "c", "spu"), (4, D("7.00"), None, None)]
    assert reports.order_amount_total(wide, "2024-05-01").first()[0] == D("107.00")
    stat = spark.read.parquet(at("stat"))
    top = reports.brand_report(stat, "2020-01-01 00:00:00", "2100-01-01 00:00:00", 2)
    assert [(r.x, r.y) for r in top.collect()] == [("a:b", D("66.66")), ("c", D("33.34"))]
