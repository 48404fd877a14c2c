import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillflow import schemas
from tillflow.operators.parsing import typed_rows
from tillflow.sinks import jdbc as jdbc_sink, kafka as kafka_sink
from tillflow.sinks.folders import names, versions
from tillflow.sinks.outputs import to_messages
from tillflow.sinks.tables import pack_days, read_days, write_batch, write_days
from tillflow.sources import jdbc, kafka
from tillflow.sources.files import table


def test_topic_options():
    first = kafka.stream_options("h:9092", "t", group="g", offsets={"t": {1: 5, 0: 7}})
    assert json.loads(first["startingOffsets"]) == {"t": {"0": 7, "1": 5}}
    assert first["subscribe"] == "t" and first["groupIdPrefix"] == "g"
    later = kafka.stream_options("h:9092", "t", max_offsets_per_trigger=10)
    assert later["startingOffsets"] == "latest" and later["maxOffsetsPerTrigger"] == "10"
    assert "topic" not in kafka_sink.sink_options("h:9092")
    assert kafka_sink.sink_options("h:9092", "t")["topic"] == "t"


def test_jdbc_options():
    assert jdbc.query_options("u", "select 1")["query"] == "select 1"
    ranged = jdbc.query_options("u", "select * from t", partition_column="id", lower=0, upper=9, partitions=3)
    assert ranged["dbtable"] == "(select * from t) q" and "query" not in ranged
    with pytest.raises(ValueError):
        jdbc.query_options("u", "select 1", partition_column="id")
    assert jdbc.bounds_query("select * from t", "id") == "SELECT min(id) AS low, max(id) AS high FROM (select * from t) q"
    out = jdbc_sink.append_options("u", "order_wide")
    assert (out["batchsize"], out["isolationLevel"], "numPartitions" in out) == ("1000", "NONE", False)


def test_a_range_is_asked_for(spark, monkeypatch):
    """The reader that a partitioned query ends up with, with the database's answer made up."""
    asked = []

    class Reader:
        def format(self, name):
            return self

        def options(self, **options):
            asked.append(options)
            return self

        def load(self):
            return spark.createDataFrame([(3, 99)], "low bigint, high bigint")

    class Session:
        read = Reader()

    jdbc.query(Session(), "u", "select * from t", partition_column="id", partitions=4)
    assert "min(id)" in asked[0]["query"] and (asked[1]["lowerBound"], asked[1]["upperBound"], asked[1]["numPartitions"]) == ("3", "99", "4")
    jdbc.query(Session(), "u", "select 1")
    assert asked[2]["query"] == "select 1"


def test_messages_round_trip(spark):
    df = spark.createDataFrame([(7, 70, "x")], "id bigint, order_id bigint, sku_name string")
    row = kafka_sink.message_rows(df, key="order_id", topic=F.lit("T")).first()
    assert (row.key, row.topic) == ("70", "T")
    assert json.loads(row.value) == {"id": 7, "order_id": 70, "sku_name": "x"}
    assert kafka_sink.message_rows(df).columns == ["value"]


def test_bare_and_quoted_values_parse_alike(spark):
    texts = ['{"id":1,"user_id":"2","final_total_amount":"12.50","create_time":"2024-05-01 10:00:00"}',
             '{"id":"1","user_id":2,"final_total_amount":12.5,"create_time":"2024-05-01 10:00:00"}']
    got = typed_rows(spark.createDataFrame([(t,) for t in texts], "value string"), schemas.ORDER_INFO, "id").collect()
    assert got[0] == got[1]
    assert (got[0].user_id, got[0].final_total_amount, got[0].operate_time) == (2, Decimal("12.50"), None)


def test_days_are_replaced_one_by_one(spark, tmp_path, rows):
    path = str(tmp_path / "days")
    days = lambda *data: spark.createDataFrame(list(data), "id bigint, d string").select("id", F.col("d").cast("date").alias("dt"))
    write_days(days((1, "2024-01-01"), (2, "2024-01-02")), path)
    write_days(days((3, "2024-01-02")), path)
    assert rows(table(spark, path, ["id"])) == [(1,), (3,)]
    pruned = table(spark, path).where(F.col("dt") == F.lit("2024-01-01").cast("date"))
    assert "PartitionFilters: [isnotnull(dt" in pruned._jdf.queryExecution().toString()


def test_a_batch_can_be_repeated(spark, tmp_path, rows):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("A", "1"), ("B", "2")], "topic string, value string")
    for _ in range(2):
        write_batch(df, path, 0)
    write_batch(df, path, 1)
    assert spark.read.parquet(path).count() == 4
    write_batch(df, str(tmp_path / "routes"), 0, ("topic",))
    assert rows(spark.read.parquet(str(tmp_path / "routes" / "topic=A" / "batch_id=0"))) == [("1",)]


def test_quiet_days_share_a_pack(spark, tmp_path, rows):
    path = str(tmp_path / "packs")
    days = spark.range(1000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("id") < 500, 40).otherwise(F.col("id") % 100).cast("int")).alias("dt"))
    staged = str(tmp_path / "staged")
    days.unionByName(days.limit(1).withColumn("dt", F.lit(None).cast("date"))).write.parquet(staged)
    table = spark.read.parquet(staged)
    pack_days(table, path, rows=100)
    packs = [n for n in names(spark, path) if n.startswith("pack=2")]
    assert 4 < len(packs) < 12 and sum(1 for _ in (tmp_path / "packs").rglob("*.parquet")) < 20
    assert read_days(spark, path, table.schema).count() == 1001
    for first, last in (("2024-01-05", None), ("2024-02-10", None), ("2024-02-01", "2024-03-01"), ("2023-01-01", "2023-12-31"), ("2024-12-01", None)):
        got = read_days(spark, path, table.schema, first, last)
        want = table.where(F.col("dt").between(F.lit(first).cast("date"), F.lit(last or first).cast("date")))
        assert rows(got) == rows(want)
    # The hot day is a pack of its own, and a quiet one reads one pack.
    busy = read_days(spark, path, table.schema, "2024-02-10")
    assert busy.count() == 505
    plan = busy._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pack" in plan and "EqualTo(dt,2024-02-10)" in plan.replace("GreaterThanOrEqual(dt,2024-02-10), LessThanOrEqual(dt,2024-02-10)", "EqualTo(dt,2024-02-10)")


def test_a_table_written_anew_has_another_version(spark, tmp_path):
    folder = tmp_path / "tables"
    spark.range(3).write.parquet(str(folder / "a.parquet"))
    before = versions(spark, str(folder))
    assert before == versions(spark, str(folder))
    spark.range(4).write.mode("overwrite").parquet(str(folder / "a.parquet"))
    assert before != versions(spark, str(folder))


def test_copies_of_a_replay_can_be_told(spark, tmp_path):
    out = to_messages(str(tmp_path / "topic"), key="id")
    out(spark.createDataFrame([(7, "x")], "id bigint, name string"), 3)
    message = spark.read.parquet(str(tmp_path / "topic")).first()
    assert json.loads(message.value) == {"id": 7, "name": "x", "batch_id": 3} and message.key == "7"
