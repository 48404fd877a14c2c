import datetime as dt
import json

from pyspark.sql import functions as F

from tillflow import schemas
from tillflow.operators import cdc, dau, dims
from tillflow.operators.parsing import rejected_rows, typed_rows


def millis(*when):
    return int(dt.datetime(*when, tzinfo=dt.timezone.utc).timestamp() * 1000)


def logs(spark, *data):
    texts = [(json.dumps({"common": {"mid": m, "uid": "u", "ar": "1", "ch": c, "vc": "v"}, "ts": ts}),)
             for m, c, ts in data]
    return typed_rows(spark.createDataFrame(texts, "value string"), schemas.STARTUP_LOG, key="ts")


def test_midnight_counts_for_both_days(spark):
    got = dau.daily_devices(logs(spark, ("a", "x", millis(2024, 1, 1, 23, 59, 59)), ("a", "x", millis(2024, 1, 2, 0, 0, 1))))
    assert sorted((r.dt.day, r.hr, r.mi) for r in got.collect()) == [(1, 23, "00"), (2, 0, "00")]


def test_first_start_of_the_day_wins(spark):
    got = dau.daily_devices(logs(spark, ("a", "late", millis(2024, 1, 1, 9)), ("a", "early", millis(2024, 1, 1, 8)),
                                 ("b", "only", millis(2024, 1, 1, 8))))
    assert sorted((r.mid, r.ch, r.hr) for r in got.collect()) == [("a", "early", 8), ("b", "only", 8)]
    assert got.columns == schemas.columns(schemas.DAU_INFO)


def test_malformed_text_is_set_aside(spark):
    raw = spark.createDataFrame([('{"ts": 1}',), ("{broken",), (None,)], "value string")
    assert typed_rows(raw, schemas.STARTUP_LOG, key="ts").count() == 1
    assert rejected_rows(raw, schemas.STARTUP_LOG, key="ts").count() == 2


def test_array_envelopes(spark, rows):
    images = [{"id": 1, "name": "x"}, {"id": 2, "n": {"deep": [1, 2]}}, {"id": 3}]
    raw = spark.createDataFrame([
        (json.dumps({"table": "order_info", "type": "DELETE", "data": images}),),
        ('{"table":"x","data":null}',), ('{"data":[{"id":1}]}',), ('{"table":"x","data":[]}',), ("nonsense",),
    ], "value string")
    got = rows(cdc.explode_images(raw))
    assert [t for t, _ in got] == ["ODS_ORDER_INFO"] * 3
    assert sorted((json.loads(v) for _, v in got), key=lambda d: d["id"]) == images


def test_object_envelopes(spark, rows):
    raw = spark.createDataFrame([
        (json.dumps({"table": "user_info", "type": "update", "data": {"id": 1, "a": {"b": 2}}}),),
        ('{"table":"x","data":null}',), ('{"table":null,"data":{"id":1}}',),
    ], "value string")
    (topic, value), = rows(cdc.route_image(raw))
    assert topic == "ODS_USER_INFO" and json.loads(value) == {"id": 1, "a": {"b": 2}}


def test_dimension_rows_rename_cast_and_filter(spark, rows):
    raw = spark.createDataFrame([('{"id":"1","spu_id":"2","tm_id":"3","category3_id":"4"}',), ('{"spu_id":"2"}',), ("x",)],
                                "value string")
    got = dims.dimension_rows(raw, "sku")
    assert got.columns == schemas.columns(schemas.SKU)
    assert rows(got) == [(1, 2, 3, 4)]
    raw = spark.createDataFrame([('{"id":61,"name":"phones"}',)], "value string")
    assert rows(dims.dimension_rows(raw, "category3")) == [(61, "phones")]
    raw = spark.createDataFrame([('{"tm_id":5,"tm_name":"a:b"}',)], "value string")
    assert rows(dims.dimension_rows(raw, "trademark")) == [(5, "a:b")]


def test_upsert_keeps_the_latest(spark, rows):
    schema = "id bigint, name string, seq int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema)
    new = spark.createDataFrame([(2, "b2", 2), (2, "b3", 3), (3, "c", 2), (None, "lost", 9)], schema)
    assert rows(dims.upsert(old, new, "id", "seq"), "id", "name") == [(1, "a"), (2, "b3"), (3, "c")]


def test_lookup(spark, rows):
    table = spark.createDataFrame([(1, "1"), (2, "1")], "user_id bigint, if_consumed string")
    batch = spark.createDataFrame([(2,), (2,), (3,)], "user_id bigint")
    assert rows(dims.lookup(table, batch, "user_id")) == [(2, "1")]
