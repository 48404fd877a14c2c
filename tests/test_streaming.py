import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tillflow.checks import replays
from tillflow.checks.replays import Arrivals, forget_commit
from tillflow.operators.parsing import sorted_rows, typed_rows
from tillflow.plans import reports
from tillflow.session import scratch_dir, state_partitions
from tillflow.sinks.tables import write_batch
from tillflow.sources.files import file_stream
from tillflow.sources.shop import TABLES, ShopTables
from tillflow.streaming import changes, devices, late, progress, sales
from tillflow.streaming.running import ARRIVED, ONCE, late_rows, salt_count, start_sorted, state_of


def feed(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def run(query):
    query.awaitTermination()
    return query


def logs(spark, *data):
    texts = [(json.dumps({"common": {"mid": m}, "ts": int(dt.datetime(2024, 1, *when, tzinfo=dt.timezone.utc).timestamp() * 1000)}),)
             for m, when in data]
    return spark.createDataFrame(texts, "value string")


@pytest.mark.parametrize("salt", [1, 4])
def test_devices_across_batches_restarts_and_late_rows(spark, tmp_path, rows, salt):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    step = lambda df: (feed(df, source), run(devices.start(
        file_stream(spark, source, "value string"), out, str(tmp_path / "check"), ONCE, salt_buckets=salt)))
    step(logs(spark, ("a", (1, 23, 59, 59)), ("a", (2, 0, 0, 1)), ("a", (2, 5)), ("b", (2, 6))))
    step(logs(spark, ("a", (2, 7)), ("b", (2, 8)), ("c", (2, 9))))  # a and b are known
    step(logs(spark, ("d", (4, 12))))
    step(logs(spark, ("e", (2, 1)), ("d", (4, 13)), ("f", (4, 13))))  # e is beyond the watermark
    got = rows(spark.read.parquet(out).select(F.dayofmonth("dt").alias("day"), "mid"))
    assert got == [(1, "a"), (2, "a"), (2, "b"), (2, "c"), (4, "d"), (4, "f")]


def test_split_counts_what_it_drops(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark.createDataFrame([('{"table":"t","data":[{"id":1},{"id":2}]}',), ('{"table":"t","data":null}',)], "value string"), source)
    query = run(changes.start_split_files(file_stream(spark, source, "value string"), "array", out, str(tmp_path / "c"), ONCE))
    metrics = query.recentProgress[0].observedMetrics["cdc_array"]
    assert (metrics.forwarded, metrics.dropped) == (1, 1)
    assert spark.read.parquet(out).groupBy("topic").count().collect()[0]["count"] == 2


def test_dimension_load_keeps_the_latest(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    table = changes.dimension_table(spark, str(tmp_path / "dim"), "trademark")
    image = lambda key, name, seq: (json.dumps({"tm_id": key, "tm_name": name}), seq)
    batches = [[image("1", "old", 1), image("1", "new", 2), ("junk", 3)], [image(2, "x", 4), image(1, "newest", 5)]]
    for batch in batches:
        feed(spark.createDataFrame(batch, "value string, seq bigint"), source)
        run(changes.start_load(file_stream(spark, source, "value string, seq bigint"), "trademark", table, str(tmp_path / "c"), trigger=ONCE))
    assert rows(table.read(), "tm_id", "tm_name") == [(1, "newest"), (2, "x")]


ORDERS = ("id bigint, user_id bigint, province_id bigint, create_time timestamp, operate_time timestamp, "
          "final_total_amount bigint, original_total_amount bigint")
LINES = "id bigint, order_id bigint, order_price bigint, sku_num bigint, sku_id bigint, create_time timestamp"
T0 = dt.datetime(2024, 5, 1, 10)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_first_orders_survive_updates_restarts_and_replays(spark, tmp_path, rows):
    province = lambda: spark.createDataFrame([(1, "p", "a", "i")], "id bigint, name string, area_code string, iso_code string")
    users = lambda: spark.createDataFrame([(7, "1990-01-01", "F")], "id bigint, birthday string, gender string")
    source, known, out, new, check = (str(tmp_path / n) for n in ("in", "known", "out", "new", "check"))
    feed(spark.createDataFrame([(9, "1"), (8, "0")], "user_id bigint, if_consumed string"), known)
    order = lambda key, user, t, op=None: (key, user, 1, at(t), op, 1, 1)
    to = lambda path: [lambda df, n: write_batch(df, path, n)]

    def step(*data):
        if data:
            feed(spark.createDataFrame(list(data), ORDERS), source)
        buyers = sales.known_buyers(file_stream(spark, known, "user_id bigint, if_consumed string"))
        run(sales.start_orders(file_stream(spark, source, ORDERS), buyers, province, users, to(out), check, ONCE, buyer_outputs=to(new)))

    flags = lambda: rows(spark.read.parquet(out), "id", "if_first_order", "batch_id")
    step(order(12, 7, 0), order(11, 7, 0), order(20, 8, 0), order(30, 9, 0))
    first = [(11, "1"), (12, "0"), (20, "1"), (30, "0")]
    assert [f[:2] for f in flags()] == first
    forget_commit(spark, check)
    step()  # the batch is done again
    assert [f[:2] for f in flags()] == first
    # The update of 11 keeps its flag; 5 is earlier but came late.
    step(order(11, 7, 0, at(9)), order(5, 7, -99), order(13, 7, 50), order(40, 6, 1))
    second = max(f[2] for f in flags())
    assert [f[:2] for f in flags() if f[2] == second] == [(11, "1"), (13, "0"), (40, "1"), (5, "0")]
    assert spark.read.parquet(out).where("user_id = 7 and user_gender = '女' and province_name = 'p'").count() == 5
    # Each new buyer once; one who becomes known in the table has no first order any more.
    assert rows(spark.read.parquet(new), "user_id", "if_consumed") == [(6, "1"), (7, "1"), (8, "1")]
    feed(spark.createDataFrame([(5, "1")], "user_id bigint, if_consumed string"), known)
    step(order(50, 5, 100))
    assert [f[:2] for f in flags() if f[0] == 50] == [(50, "0")]


def test_one_source_feeds_rows_and_state(spark, tmp_path):
    source = str(tmp_path / "in")
    feed(spark.createDataFrame([(1, 7, 1, at(0), None, 1, 1)], ORDERS), source)
    query = run(sales.start_orders(
        file_stream(spark, source, ORDERS), None, lambda: spark.createDataFrame([], "id bigint, name string, area_code string, iso_code string"),
        lambda: spark.createDataFrame([], "id bigint, birthday string, gender string"), [lambda df, n: df.collect()], str(tmp_path / "c"), ONCE))
    assert {len(p.sources) for p in query.recentProgress} == {1}


@pytest.mark.parametrize("salt", [1, 4])
def test_join_bound_and_duplicates(spark, tmp_path, rows, salt):
    o, l, out = (str(tmp_path / n) for n in ("o", "l", "out"))
    order = lambda key, t, op=1: (key, 1, 1, at(t), at(t + op) if op else None, 10, 10)
    line = lambda key, order_id, t: (key, order_id, 10, 1, 1, at(t))

    def step(orders, lines):
        feed(spark.createDataFrame(orders, ORDERS), o)
        feed(spark.createDataFrame(lines, LINES), l)
        joined = sales.join_streams(file_stream(spark, o, ORDERS), file_stream(spark, l, LINES), salt_buckets=salt)
        run(sales.start_join(joined, out, str(tmp_path / "c"), ONCE))

    step([order(1, 0), order(2, 0), order(3, 0, op=None)],
         [line(101, 1, 3), line(101, 1, 3), line(102, 2, 11), line(103, 3, 1)])
    step([order(4, 20)], [line(104, 4, 15), line(105, 1, 9), line(104, 4, 15)])
    # 102 is 11 seconds after its order, 103's order was never operated on.
    assert rows(spark.read.parquet(out), "order_id", "order_detail_id") == [(1, 101), (1, 105), (4, 104)]


JOINED = ("order_detail_id bigint, order_id bigint, create_time timestamp, sku_price bigint, sku_num bigint, "
          "final_total_amount bigint, original_total_amount bigint")


def split_steps(spark, tmp_path, **options):
    source, out, check = (str(tmp_path / n) for n in ("joined", "out", "check"))

    def step(*data, again=False):
        if again:
            forget_commit(spark, check)
        if data:
            feed(spark.createDataFrame(list(data), JOINED), source)
        run(sales.start_split(file_stream(spark, source, JOINED), [lambda df, n: write_batch(df, out, n)], check, ONCE, **options))
        return {r.order_detail_id: r.final_detail_amount for r in spark.read.parquet(out).collect()}

    return step


def test_split_over_batches_adds_up(spark, tmp_path):
    line = lambda key, order_id=1, price=4000, final=10000, original=12000: (key, order_id, at(order_id), price, 1, final, original)
    step = split_steps(spark, tmp_path)
    batches = [[line(1), line(10, 2, 4000, 3350, 4000)], [line(3)], [line(2), line(20, 3, 0, 5, 0)], [line(21, 3, 0, 5, 0)]]
    for batch in batches:
        step(*batch)
        got = step(again=True)  # every batch is done once more
    assert got == {1: 3333, 3: 3333, 2: 3334, 10: 3350, 20: 5, 21: 0}


def test_the_state_of_the_split_goes_by_its_own_watermark(spark, tmp_path):
    """Lines of an order may be a day apart; orders beyond that leave the state."""
    step = split_steps(spark, tmp_path, watermark="1 day")
    line = lambda key, order_id, day, price=50: (key, order_id, at(day * 86400), price, 1, 99, 100)
    step(line(1, 1, 0))
    got = step(line(2, 1, 0), line(3, 2, 3))
    assert got[1] + got[2] == 99
    step(line(4, 3, 9))
    state = spark.read.format("statestore").load(str(tmp_path / "check"))
    assert {r.key.order_id for r in state.collect()} == {3}


def test_one_order_dated_far_ahead_takes_nothing_with_it(spark, tmp_path, rows):
    """Orders 1 and 3 of 2024, order 2 of 2099: the stream takes 1 and 3, the repair finds 2."""
    o, l, out, split, c = (str(tmp_path / n) for n in ("o", "l", "out", "split", "c"))
    ahead = (dt.datetime(2099, 1, 1) - T0).total_seconds()
    order = lambda key, t: (key, 1, 1, at(t), at(t + 1), 99, 100)
    line = lambda key, order_id, t: (key, order_id, 50, 1, 1, at(t))
    joined = lambda: sales.join_streams(file_stream(spark, o, ORDERS), file_stream(spark, l, LINES))

    def step(orders, lines):
        feed(spark.createDataFrame(orders, ORDERS), o)
        feed(spark.createDataFrame(lines, LINES), l)
        schema = joined().schema
        run(sales.start_join(joined(), out, f"{c}1", ONCE))
        run(sales.start_split(file_stream(spark, out, schema), [lambda df, n: write_batch(df, split, n)], f"{c}2", ONCE))

    step([order(1, 0), order(2, ahead)], [line(11, 1, 1), line(21, 2, ahead), line(22, 2, ahead)])
    step([order(3, 7200)], [line(12, 1, 2), line(31, 3, 7201), line(32, 3, 7202)])
    stored = spark.read.parquet(split).drop("batch_id")
    shares = lambda df: {k: sorted(r.final_detail_amount for r in g) for k, g in by_order(df).items()}
    assert shares(stored) == {1: [49, 50], 3: [49, 50]}
    missed = late.missed(spark.read.schema(ORDERS).parquet(o), spark.read.schema(LINES).parquet(l), stored)
    assert shares(late.repair(missed, stored)) == {2: [49, 50]}


def by_order(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.order_id, []).append(r)
    return out


def test_a_repaired_line_gets_what_is_left(spark):
    stored = spark.createDataFrame([(1, 1, 50, 1, 50), (5, 9, 10, 1, 10)], "order_detail_id bigint, order_id bigint, sku_price bigint, sku_num bigint, final_detail_amount bigint")
    orders = spark.createDataFrame([(1, 1, 1, at(0), at(1), 99, 100), (9, 1, 1, at(0), at(1), 10, 10)], ORDERS)
    lines = spark.createDataFrame([(1, 1, 50, 1, 1, at(1)), (2, 1, 50, 1, 1, at(2)), (2, 1, 50, 1, 1, at(2)), (3, 1, 50, 1, 1, at(99)), (5, 9, 10, 1, 1, at(1))], LINES)
    got = late.repair(late.missed(orders, lines, stored), stored).collect()
    # Line 2 once, although sent again; line 3 is beyond the bound.
    assert [(r.order_detail_id, r.final_detail_amount) for r in got] == [(2, 49)]


@pytest.mark.parametrize("forever", [True, False])
def test_a_line_sent_again_after_days_counts_once(spark, tmp_path, rows, forever):
    o, l, out = (str(tmp_path / n) for n in ("o", "l", "out"))
    for day in (0, 3, 6):
        t = day * 86400
        feed(spark.createDataFrame([(1, 1, 1, at(t), at(t), 10, 10), (2 + day, 1, 1, at(t), at(t), 10, 10)], ORDERS), o)
        feed(spark.createDataFrame([(101, 1, 10, 1, 1, at(t)), (200 + day, 2 + day, 10, 1, 1, at(t))], LINES), l)
        joined = sales.join_streams(file_stream(spark, o, ORDERS), file_stream(spark, l, LINES), forever=forever)
        run(sales.start_join(joined, out, str(tmp_path / "c"), ONCE))
    got = dict(rows(spark.read.parquet(out).groupBy("order_detail_id").count()))
    # With the watermark the state goes, and the line counts again.
    assert got == {101: 1 if forever else got[101], 200: 1, 203: 1, 206: 1} and (got[101] > 1) != forever


def test_a_batch_done_again_after_midnight_is_booked_once(spark, tmp_path, rows):
    source, out, check = (str(tmp_path / n) for n in ("in", "stat", "check"))
    schema = "tm_id bigint, tm_name string, final_detail_amount bigint"

    def step(*data):
        if data:
            feed(spark.createDataFrame(list(data), schema), source)
        run(sales.start_brand(file_stream(spark, source, schema), out, check, ONCE))

    step((1, "a", 3), (1, "a", 4))
    before = rows(spark.read.parquet(out))
    forget_commit(spark, check)
    step()
    assert rows(spark.read.parquet(out)) == before
    step((1, "a", 5), (2, "b:c", 1))
    got = spark.read.parquet(out)
    assert rows(got, "batch_id", "trademark_id", "trademark_name", "amount") == [(0, 1, "a", 7), (1, 1, "a", 5), (1, 2, "b:c", 1)]
    assert got.select("stat_time").distinct().count() == 2
    # The stamp is the batch's own, whatever the clock says when it is done: 23:59:59, and once more at 00:00:03.
    stamped = spark.createDataFrame([(1, "a", 100, dt.datetime(2024, 5, 1, 23, 59, 59))], f"{schema}, {ARRIVED} timestamp")
    each = sales.brand_batch(str(tmp_path / "late"))
    for _ in range(2):
        each(stamped, 7)
    assert rows(spark.read.parquet(str(tmp_path / "late")), "amount", "batch_id") == [(100, 7)]


def test_hours_are_kept_current(spark, tmp_path, rows):
    source, table = str(tmp_path / "in"), sales.hour_table(spark, str(tmp_path / "hours"))
    schema = "create_time timestamp, final_detail_amount bigint"
    for batch in ([(at(0), 5), (at(3600), 7)], [(at(10), 1), (at(7200), 2)]):
        feed(spark.createDataFrame(batch, schema), source)
        run(sales.start_hours(file_stream(spark, source, schema), table, str(tmp_path / "c"), ONCE))
    assert [(h, int(a)) for h, a in rows(table.read(), "hr", "order_amount")] == [(10, 6), (11, 7), (12, 2)]


def test_new_devices_are_indexed_once(spark, tmp_path, rows):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def step(*data):
        if data:
            feed(logs(spark, *data), source)
        to = [lambda df, n: write_batch(df, out, n, ("dt",))]
        run(devices.start_first_seen(file_stream(spark, source, "value string"), to, check, ONCE))

    step(("a", (2, 5)), ("a", (1, 5)), ("b", (2, 6)))
    step(("a", (3, 5)), ("c", (3, 6)))
    forget_commit(spark, check)
    step()
    seen = spark.read.parquet(out)
    assert rows(seen.select(F.dayofmonth("dt").alias("d"), "mid")) == [(1, "a"), (2, "b"), (3, "c")]
    active = spark.createDataFrame([(dt.date(2024, 1, 3), 5, "a"), (dt.date(2024, 1, 3), 6, "c")], "dt date, hr int, mid string")
    assert reports.device_totals(active, "2024-01-03", seen).first()[:] == (2, 1)


def test_rejected_texts_are_kept_with_their_reason(spark, tmp_path, rows):
    source, good, bad = (str(tmp_path / n) for n in ("in", "good", "bad"))
    texts = ['{"common":{"mid":"a"},"ts":1}', '{"common":{"mid":"b"},"ts":"2"}', "junk", "", None, '{"ts":3}', '{"common":{"mid":null},"ts":3}',
             '{"common":{"mid":"c"}}', '{"common":{"mid":"c"},"ts":"x"}', "[]", '{"common":5,"ts":3}']
    feed(spark.createDataFrame([(t,) for t in texts], "value string"), source)
    out = lambda path: [lambda df, n: write_batch(df, path, n)]
    schema = "common struct<mid:string>, ts bigint"
    stream = sorted_rows(file_stream(spark, source, "value string"), schema, key="ts", also="common.mid")
    run(start_sorted(stream, out(good), out(bad), str(tmp_path / "c"), ONCE))
    assert rows(spark.read.parquet(good).select("common.mid", "ts")) == [("a", 1), ("b", 2)]
    reasons = {r.value: r.reason for r in spark.read.parquet(bad).collect()}
    assert len(reasons) == len(texts) - 2 and reasons['{"ts":3}'] == reasons['{"common":{"mid":null},"ts":3}'] == "no common.mid"
    assert reasons['{"common":{"mid":"c"}}'] == reasons['{"common":{"mid":"c"},"ts":"x"}'] == "no ts" and reasons["junk"] == reasons[None] == "no JSON object"
    # The same texts as typed_rows leaves out.
    assert typed_rows(spark.createDataFrame([(t,) for t in texts], "value string"), schema, "ts", also="common.mid").count() == 2
    batch = sorted_rows(spark.read.schema("value string").parquet(source), schema, key="ts", also="common.mid")
    assert batch._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_every_batch_is_logged(spark, tmp_path):
    source, log = str(tmp_path / "in"), progress.BatchLog(spark, str(tmp_path / "log"), ("logged",)).attach()
    try:
        for day in (1, 5, 9):
            feed(logs(spark, ("a", (day, 5)), ("a", (day, 6)), ("b", (1, 1))), source)
            run(devices.start(file_stream(spark, source, "value string"), str(tmp_path / "out"), str(tmp_path / "c"), ONCE, salt_buckets=1, name="logged"))
    finally:
        log.detach()
    got = sorted(progress.batches(spark, str(tmp_path / "log")).collect(), key=lambda r: r.batch_id)
    assert [r.batch_id for r in got] == list(range(len(got))) and len({r.run for r in got}) == 3
    assert sum(r.input_rows for r in got) == 9 and sum(r.late_rows for r in got) == 1
    assert sum((r.metrics.get("dau_before") or {}).get("rows", 0) for r in got) == 9
    assert sum((r.metrics.get("dau_after") or {}).get("rows", 0) for r in got) == spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert all('"end"' in r.positions for r in got) and got[-1].watermark > got[0].watermark


def test_arrivals_hold_every_row_once(spark, tmp_path):
    source = Arrivals(spark.range(100).withColumn("k", F.col("id") * F.col("id")), str(tmp_path), by="k", slices=4)
    source.cut()
    for number in range(4):
        source.arrive(number)
    got = spark.read.parquet(source.incoming)
    assert (got.count(), got.distinct().count()) == (100, 100)


def test_arrivals_move_what_was_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (2, None), (3, 40), (4, 25)], "id bigint, k bigint")
    first, second = (Arrivals(rows, str(tmp_path / n), by="k", slices=2) for n in "ab")
    bounds = first.cut()
    second.cut((20, 30))  # beyond another table's bounds the first and the last slice take all
    got = []
    for number in range(2):
        for source in (first, second):
            source.arrive(number)
            got.append(sorted(r.id for r in spark.read.parquet(source.incoming).collect()))
    assert bounds == (10, 40) and got == [[1, 4], [1, 4], [1, 3, 4], [1, 3, 4]]
    left = [p.parent.name for p in (tmp_path / "a" / "staged").rglob("*.parquet")]
    assert left == ["_slice=__HIVE_DEFAULT_PARTITION__"]


def test_a_query_that_stops_plays_no_changes_back(spark, tmp_path, rows):
    """Its state files are committed, no look-up counts the rows, and the session's settings stay what they were."""
    o, l, out, c = (str(tmp_path / n) for n in ("o", "l", "out", "c"))
    keys = [f"spark.sql.streaming.stateStore.rocksdb.{name}" for name in ("changelogCheckpointing.enabled", "trackTotalNumberOfRows")]
    before = [spark.conf.get(key, None) for key in keys]
    for step, count in ((0, False), (1, False), (2, True)):
        feed(spark.createDataFrame([(step, 1, 1, at(step), at(step), 10, 10)], ORDERS), o)
        feed(spark.createDataFrame([(100 + step, step, 10, 1, 1, at(step)), (200 + step, 2 - step, 10, 1, 1, at(step))], LINES), l)
        joined = sales.join_streams(file_stream(spark, o, ORDERS), file_stream(spark, l, LINES))
        query = run(sales.start_join(joined, out, c, ONCE, count_state=count))
        counted = sum(int(state.numRowsTotal) for state in query.recentProgress[0].stateOperators)
        assert (counted > 0) == count and [spark.conf.get(key, None) for key in keys] == before
    assert not list((tmp_path / "c" / "state").rglob("*.changelog")) and list((tmp_path / "c" / "state").rglob("*.zip"))
    assert rows(spark.read.parquet(out), "order_id", "order_detail_id") == [(0, 100), (0, 202), (1, 101), (1, 201), (2, 102), (2, 200)]
    assert state_of({"processingTime": "5 seconds"}) == {}  # short batches go on committing their changes


def odd_shop(spark, folder):
    """Orders without date, buyer or lines, a buyer that comes twice, and an order that does."""
    day = dt.datetime(1994, 5, 1)
    tables = {
        "customer": [(1, "a", 1, 0.0, "x"), (2, "b", 2, 0.0, "x"), (2, "b", 3, 0.0, "x"), (None, "c", 1, 0.0, "x")],
        "orders": [(1, 1, "O", 10.0, day, "1"), (1, 1, "O", 10.0, day, "1"), (2, 2, "P", 5.0, day, "1"), (3, 2, None, 5.0, day, "1"),
                   (4, 1, "F", 5.0, None, "1"), (5, None, "F", 5.0, day, "1"), (6, 1, "F", 5.0, dt.datetime(1996, 1, 1), "1"), (None, 1, "F", 5.0, day, "1")],
        "lineitem": [(key, 1, 1, n, 2.0, 3.0, 0.0, 0.0, "N", "O", day) for key in (1, 2, 4, 6, None) for n in (1, 2, None)],
    }
    for name, data in tables.items():
        spark.createDataFrame(data, TABLES[name]).write.parquet(f"{folder}/{name}.parquet")
    return ShopTables(spark, str(folder))


def test_order_times_are_those_of_the_headers_without_the_lines(spark, tmp_path, rows):
    shop = odd_shop(spark, tmp_path)
    times = shop.order_times()
    assert rows(times) == rows(shop.order_info(), "id", "create_time", "operate_time")
    assert not [f for f in times.inputFiles() if "lineitem" in f] and [f for f in shop.order_info().inputFiles() if "lineitem" in f]


def test_images_come_from_one_pass_over_the_orders(spark, tmp_path, rows):
    shop = odd_shop(spark, tmp_path / "shop")
    orders, lines = replays._paid_later(shop, str(tmp_path / "work"))
    headers, arrival = shop.order_info(), F.year("create_time") - 1992
    both = headers.withColumn("operate_time", F.lit(None).cast("timestamp")).withColumn("arrival", arrival).unionByName(
        headers.where("operate_time IS NOT NULL").withColumn("arrival", arrival + 1))
    assert rows(orders.df) == rows(both) and orders.cut() == both.agg(F.min("arrival"), F.max("arrival")).first()[:]
    assert "Union" not in orders.df._jdf.queryExecution().optimizedPlan().toString()
    assert lines.df.count() == shop.order_detail().join(headers.select(F.col("id").alias("order_id")), "order_id").count()


def test_the_repair_reads_what_has_come_in(spark, tmp_path, monkeypatch):
    sources = [Arrivals(spark.range(9).withColumn("k", F.col("id")), str(tmp_path / n), by="k", slices=1) for n in "ab"]
    for source in sources:
        source.cut()
        source.arrive(0)
    read = []
    monkeypatch.setattr(replays.late, "missed", lambda *given: read.extend(f for df in given[:2] for f in df.inputFiles()) or given[0])
    got = replays._missed(sources, spark.range(1), str(tmp_path))
    assert read and all("/incoming/" in f for f in read) and got.count() == 9
    assert not (tmp_path / "a" / "incoming").exists() and not (tmp_path / "b" / "incoming").exists()


def test_orders_are_not_kept_for_every_state_partition(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        joined = sales.join_streams(spark.createDataFrame([], ORDERS), spark.createDataFrame([], LINES))
        text = joined._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(key, before)
    assert re.findall(r"explode\(sequence\(0, (\d+)|explode\(sequence\(0, cast\((\d+)|explode\(sequence\(0, \((\d+)", text) and "33" not in text


def test_lookups_of_products_do_not_read_the_lines_again(spark, tmp_path, monkeypatch):
    asked, out = [], []
    empty = lambda *names: spark.createDataFrame([], ", ".join(f"{n} bigint" for n in names))
    dims = empty("sku_id", "spu_id", "tm_id", "category3_id"), empty("spu_id", "spu_name"), empty("tm_id", "tm_name"), empty("category3_id", "category3_name")
    monkeypatch.setattr(sales, "products_of", lambda tables, keys: asked.append((keys.columns, keys.count(), keys.storageLevel.useMemory)) or dims)
    each = sales.detail_batch(spark, str(tmp_path / "landing"), (None,) * 4, [lambda df, n: out.extend(df.collect())])
    each(spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "id bigint, sku_id bigint"), 0)
    assert asked == [(["sku_id"], 3, True)] and sorted(r.id for r in out) == [1, 2, 3, 4]


def test_orders_paid_after_the_bound_reach_the_wide_table(spark, tmp_path, rows):
    o, l, out = (str(tmp_path / n) for n in ("o", "l", "out"))
    order = lambda key, t, op=None: (key, 1, 1, at(t), op, 10, 10)
    line = lambda key, order_id, t: (key, order_id, 10, 1, 1, at(t))

    def step(orders, lines):
        feed(spark.createDataFrame(orders, ORDERS), o)
        feed(spark.createDataFrame(lines, LINES), l)
        joined = sales.join_streams(file_stream(spark, o, ORDERS), file_stream(spark, l, LINES))
        return run(sales.start_join(joined, out, str(tmp_path / "c"), ONCE))

    step([order(1, 0)], [line(101, 1, 1)])
    step([order(2, 60, at(61))], [line(102, 2, 60)])
    step([order(1, 0, at(3600)), order(3, 2 * 86400, at(2 * 86400))], [line(103, 3, 2 * 86400)])
    assert rows(spark.read.parquet(out), "order_id", "order_detail_id") == [(1, 101), (2, 102), (3, 103)]
    # Two days on, a line of the first day is late, and counted.
    behind = step([], [line(104, 2, 61)])
    assert late_rows(behind) > 0 and spark.read.parquet(out).count() == 3


def test_batch_and_stream_split_agree_on_incomplete_orders(spark, tmp_path):
    from tillflow.operators import wide

    data = [(i, 1, at(0), 4000, 1, 10000, 12000) for i in (1, 2)] + [(9, 2, at(0), 10, 1, 7, 10)]
    got = split_steps(spark, tmp_path)(*data)
    shares = {r.order_detail_id: r.final_detail_amount for r in wide.apportion(spark.createDataFrame(data, JOINED)).collect()}
    assert shares == got == {1: 3333, 2: 3333, 9: 7}


def test_logs_without_a_device_are_rejected(spark, tmp_path):
    from tillflow.operators.dau import daily_devices

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(logs(spark, ("a", (1, 5)), (None, (1, 6)), (None, (1, 7))), source)
    query = run(devices.start(file_stream(spark, source, "value string"), out, str(tmp_path / "c"), ONCE))
    assert [r.mid for r in spark.read.parquet(out).collect()] == ["a"]
    metrics = query.recentProgress[0].observedMetrics["startup_parsed"]
    assert (metrics.parsed, metrics.rejected) == (1, 2)
    plain = spark.createDataFrame([((None, "u", "a", "c", "v"), 1), (("b", "u", "a", "c", "v"), 2)],
                                  "common struct<mid:string,uid:string,ar:string,ch:string,vc:string>, ts bigint")
    assert [r.mid for r in daily_devices(plain).collect()] == ["b"]
    # What came too late for the stream is what the stored days lack.
    assert devices.late_devices(plain, spark.read.parquet(out)).count() == 1


def test_state_partitions_are_the_sessions_or_the_callers(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")
    try:
        with state_partitions(spark):
            assert spark.conf.get(key) == "200"
        with state_partitions(spark, 7):
            assert spark.conf.get(key) == "7"
        assert spark.conf.get(key) == "200" and salt_count(spark.range(1), None) == 34 and salt_count(spark.range(1), 2) == 2
    finally:
        spark.conf.set(key, before)


def test_no_machine_local_scratch_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch_dir(Session(), "x")
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/"}
    assert scratch_dir(Session(), "x").startswith("hdfs://shared/x-")


def test_a_lookup_reads_the_folders_of_its_keys(spark, tmp_path, rows):
    table = changes.dimension_table(spark, str(tmp_path / "dim"), "user")
    people = spark.range(1000).selectExpr("id", "'1990-01-01' AS birthday", "'F' AS gender", "CAST(0 AS BIGINT) AS seq")
    table.seed(people)
    table.seed(people.where("id < 0"))
    table.write(people.where("id < 2").selectExpr("id", "birthday", "'M' AS gender", "CAST(1 AS BIGINT) AS seq"), 0)
    found = table.read(spark.createDataFrame([(1,), (7,)], "id bigint"))
    assert rows(found, "id", "gender") == [(1, "M"), (7, "F")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and plan.index("Window [") < plan.index("LeftSemi")
    assert table.read().count() == 1000


def test_a_batch_of_few_products_reads_few_files(spark, tmp_path):
    sku = changes.dimension_table(spark, str(tmp_path / "sku"), "sku")
    sku.seed(spark.range(5000).selectExpr("id AS sku_id", "id % 50 AS spu_id", "id % 9 AS tm_id", "id % 7 AS category3_id", "CAST(0 AS BIGINT) AS seq"))
    rest = []
    for name, key, text, n in (("spu", "spu_id", "spu_name", 50), ("trademark", "tm_id", "tm_name", 9), ("category3", "category3_id", "category3_name", 7)):
        table = changes.dimension_table(spark, str(tmp_path / name), name)
        table.seed(spark.range(n).selectExpr(f"id AS {key}", f"concat('x', id) AS {text}", "CAST(0 AS BIGINT) AS seq"))
        rest.append(table)
    lines = spark.createDataFrame([(1, 3), (2, 3), (3, 44)], "id bigint, sku_id bigint")
    found = sales.products_of((sku, *rest), lines)
    assert [df.count() for df in found] == [2, 2, 2, 2]
    found[0].collect()
    scans = found[0].inputFiles()
    everything = sum(1 for _ in (tmp_path / "sku").rglob("*.parquet"))
    assert "PartitionFilters: [bucket" in found[0]._jdf.queryExecution().executedPlan().toString() and everything >= 32
    read = re.findall(r"bucket#\d+ IN \(([\d,]+)\)|bucket#\d+ = (\d+)", found[0]._jdf.queryExecution().optimizedPlan().toString())
    assert scans and read and all(len((many or one).split(",")) <= 2 for many, one in read)


def test_a_rewritten_table_has_one_change_per_key(spark, tmp_path, rows):
    table = changes.dimension_table(spark, str(tmp_path / "dim"), "trademark")
    assert table.read().count() == 0
    made = lambda *data: spark.createDataFrame(list(data), "tm_id bigint, tm_name string, seq bigint")
    table.write(made((1, "a", 1), (2, "b", 2), (1, "later", 3)), 0)
    for name in ("lost", "c"):  # a batch that is done again replaces itself
        table.write(made((2, name, 1)), 1)
    assert rows(table.read(), "tm_id", "tm_name") == [(1, "later"), (2, "c")]
    fresh = table.rewrite(str(tmp_path / "fresh"))
    assert fresh.changes().count() == 2 and rows(fresh.read()) == rows(table.read())
    fresh.write(made((3, "d", 1)), 7)
    assert rows(fresh.read(), "tm_id") == [(1,), (2,), (3,)]
