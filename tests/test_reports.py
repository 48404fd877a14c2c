import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tillflow.plans import reports

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


@pytest.fixture
def dau(spark):
    return spark.createDataFrame(
        [(D1, 9, "a"), (D1, 9, "b"), (D2, 9, "a"), (D2, 10, "c"), (D2, 10, "d")], "dt date, hr int, mid string")


@pytest.fixture
def wide(spark):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    return spark.createDataFrame(
        [(D1, at(1, 10), 100), (D2, at(2, 9), 5), (D2, at(2, 10), 7), (D2, at(2, 10), 8)],
        "dt date, create_time timestamp, final_detail_amount bigint")


def test_totals_and_empty_day(dau, wide):
    assert reports.dau_total(dau, "2024-01-02").first()[0] == 3
    assert reports.dau_total(dau, "2024-01-09").first()[0] == 0
    assert reports.order_amount_total(wide, "2024-01-02").first()[0] == 20
    assert reports.order_amount_total(wide, "2024-01-09").first()[0] is None


def test_hours_add_up(dau, wide):
    hours = {r.hr: r.order_amount for r in reports.order_amount_by_hour(wide, "2024-01-02").collect()}
    assert hours == {9: 5, 10: 15}
    assert {r.hr: r.dau for r in reports.dau_by_hour(dau, "2024-01-02").collect()} == {9: 1, 10: 2}


def test_hour_map(wide):
    got = reports.hour_map(reports.order_amount_by_hour(wide, "2024-01-02"), "order_amount")
    assert json.loads(got.select(F.to_json("hours")).first()[0]) == {"9": 5, "10": 15}


def test_headline(dau, wide):
    got = {r.id: (r.name, r.value) for r in reports.day_headline(dau, wide, "2024-01-02").collect()}
    assert got == {"dau": ("新增日活", 3), "new_mid": ("新增设备", 2), "order_amount": ("新增交易额", 20)}
    empty = {r.id: r.value for r in reports.day_headline(dau, wide, "2024-02-02").collect()}
    assert empty == {"dau": 0, "new_mid": 0, "order_amount": None}


def test_curves(dau, wide, rows):
    assert rows(reports.hour_curve("dau", dau, "2024-01-02")) == [
        ("today", 10, 2), ("today", 9, 1), ("yesterday", 9, 2)]
    assert rows(reports.hour_curve("order_amount", wide, "2024-01-02")) == [
        ("today", 10, 15), ("today", 9, 5), ("yesterday", 10, 100)]
    assert reports.hour_curve("other", dau, "2024-01-02") is None
    with pytest.raises(ValueError):
        reports.hour_curve("dau", dau, "01/02/2024")


def test_distinct_devices(dau, rows):
    assert rows(reports.dau_distinct(dau)) == [(D1, 2), (D2, 3)]


def test_brand_report(spark):
    stat = spark.createDataFrame([(dt.datetime(2024, 1, 2), 1, "a", 5)],
                                 "stat_time timestamp, trademark_id bigint, trademark_name string, amount bigint")
    got = reports.brand_report(stat, "2024-01-01 00:00:00", "2024-01-03 00:00:00", 3).collect()
    assert [tuple(r) for r in got] == [("a", 5, 1)]
