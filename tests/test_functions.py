import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillflow import schemas
from tillflow.functions import (
    age_group, as_cents, from_cents, gender_label, ods_topic, open_range, parse_day, share_cents,
)
from tillflow.functions.people import AGE_20_TO_50, AGE_FROM_50, AGE_UNDER_20


def bucket(spark, birthday, as_of):
    df = spark.createDataFrame([(birthday,)], "b string")
    return df.select(age_group(F.col("b"), F.lit(as_of).cast("date"))).first()[0]


@pytest.mark.parametrize("birthday, as_of, want", [
    ("2000-06-15", "2020-06-14", AGE_UNDER_20),
    ("2000-06-15", "2020-06-15", AGE_20_TO_50),
    ("1970-06-15", "2020-06-14", AGE_20_TO_50),
    ("1970-06-15", "2020-06-15", AGE_FROM_50),
    ("2000-02-29", "2020-02-28", AGE_UNDER_20),
    ("2000-02-29", "2020-02-29", AGE_20_TO_50),
    ("2004-02-29", "2054-02-27", AGE_20_TO_50),
    ("2004-02-29", "2054-02-28", AGE_FROM_50),
    ("abc", "2020-01-01", None),
    (None, "2020-01-01", None),
])
def test_age_group(spark, birthday, as_of, want):
    assert bucket(spark, birthday, as_of) == want


def test_gender_label(spark):
    df = spark.createDataFrame([("M",), ("F",), ("X",), (None,)], "g string")
    assert [r[0] for r in df.select(gender_label(F.col("g"))).collect()] == ["男", "女", None, None]


def half_up(line, final, original):
    if original <= 0:
        return None
    return (2 * line * final + original) // (2 * original)


def test_share_cents_matches_exact_integers(spark):
    rng = random.Random(7)
    data = [(4000, 10000, 12000), (0, 500, 0), (1, 1, 2), (1, 1, 3), (-1, 1, 2), (-3, 1, 2), (10, 5, -4)]
    for bits in (10, 29, 31, 40, 55):
        data += [(rng.randrange(-(1 << bits), 1 << bits), rng.randrange(1 << min(bits, 50)),
                  rng.randrange((1 << bits) // 2, 1 << bits)) for _ in range(50)]
    df = spark.createDataFrame(data, "l bigint, f bigint, o bigint")
    for r in df.withColumn("s", share_cents("l", "f", "o")).collect():
        assert r.s == half_up(r.l, r.f, r.o), r


def test_cents_of_every_unit(spark):
    df = spark.createDataFrame([(1234, Decimal("12.34"), 12.34)], "i bigint, d decimal(16,2), f double")
    got = df.select(as_cents(df, "i"), as_cents(df, "d"), as_cents(df, "f")).first()
    assert tuple(got) == (1234, 1234, 1234)
    back = df.select(*(from_cents(F.lit(-5), df.schema[c].dataType) for c in "idf")).first()
    assert tuple(back) == (-5, Decimal("-0.05"), -0.05)


def test_parse_day_is_strict():
    assert parse_day("2024-01-02") == dt.date(2024, 1, 2)
    for bad in ("2024-13-01", "yesterday", "2024-01-02 10:00:00"):
        with pytest.raises(ValueError):
            parse_day(bad)


def test_open_range_excludes_both_ends(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "t string")
    inside = df.where(open_range(F.col("t").cast("timestamp"), "2024-01-01 00:00:00", "2024-01-03 00:00:00"))
    assert [r[0] for r in inside.collect()] == ["2024-01-02"]


def test_topic(spark):
    assert spark.range(1).select(ods_topic(F.lit("order_info"))).first()[0] == "ODS_ORDER_INFO"


def test_schema_columns():
    assert schemas.columns("a decimal(16,2), b struct<x:int,y:int>, `c` string") == ["a", "b", "c"]
    assert schemas.source_schema("category3") == "id bigint, name string"
