import datetime as dt

from pyspark.sql import functions as F

from tillflow.operators import orders

T = dt.datetime(2024, 5, 1, 10, 0, 0)


def make(spark, data):
    return spark.createDataFrame(data, "id bigint, user_id bigint, create_time timestamp")


def state(spark, *users):
    return spark.createDataFrame([(u, "1") for u in users], "user_id bigint, if_consumed string")


def flags(df):
    return {r.id: r.if_first_order for r in df.collect()}


def test_tie_goes_to_the_lower_id(spark):
    df = make(spark, [(12, 7, T), (11, 7, T), (13, 7, T - dt.timedelta(days=-1))])
    assert flags(orders.with_first_flag(df, state(spark))) == {11: "1", 12: "0", 13: "0"}


def test_consumed_buyer_has_no_first_order(spark):
    df = make(spark, [(1, 10, T), (2, 10, T), (3, 11, T)])
    got = orders.with_first_flag(df, state(spark, 10))
    assert flags(got) == {1: "0", 2: "0", 3: "1"}
    assert [tuple(r) for r in orders.new_consumed_users(got).collect()] == [(11, "1")]


def test_raw_flag_marks_every_order_of_a_new_buyer(spark):
    df = make(spark, [(1, 10, T), (2, 11, T), (3, 11, T)])
    assert flags(orders.with_consumed_flag(df, state(spark, 10))) == {1: "0", 2: "1", 3: "1"}


def test_state_other_than_one_is_not_consumed(spark):
    other = spark.createDataFrame([(10, "0"), (11, None)], "user_id bigint, if_consumed string")
    df = make(spark, [(1, 10, T), (2, 11, T)])
    assert flags(orders.with_first_flag(df, other)) == {1: "1", 2: "1"}
    assert flags(orders.with_consumed_flag(df, other)) == {1: "1", 2: "1"}


def test_unknown_region_and_buyer_keep_the_order(spark):
    df = spark.createDataFrame([(1, 5, 9)], "id bigint, user_id bigint, province_id bigint")
    province = spark.createDataFrame([(1, "a", "b", "c")], "id bigint, name string, area_code string, iso_code string")
    users = spark.createDataFrame([(6, "1990-01-01", "M")], "id bigint, birthday string, gender string")
    got = orders.with_user(orders.with_province(df, province), users).first()
    assert got.id == 1 and got.province_name is None and got.user_age_group is None and got.user_gender is None


def test_times(spark):
    got = orders.with_day_hour(make(spark, [(1, 1, dt.datetime(2024, 5, 1, 9, 59, 59))])).first()
    assert (got.create_date, got.create_hour) == (dt.date(2024, 5, 1), 9)


def test_operated(spark):
    df = spark.createDataFrame([(1, T), (2, None)], "id bigint, operate_time timestamp")
    assert [r.id for r in orders.operated(df).collect()] == [1]
