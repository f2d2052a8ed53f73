"""A stream's table under failures at every point, and two joined streams that forget what is over."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from factorloom.operators import trades as trade_operators
from factorloom.streaming import feeds, sinks

T0 = dt.datetime(2020, 1, 1)
FEED = "k string, ts timestamp, x int"


def day(n):
    return T0 + dt.timedelta(days=n)


def put(spark, folder, number, rows, schema):
    """A file that arrives after those of lower numbers."""
    os.makedirs(folder, exist_ok=True)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}-{number}")
    part = next(f for f in os.listdir(f"{folder}-{number}") if f.endswith(".parquet"))
    shutil.copy(f"{folder}-{number}/{part}", f"{folder}/{number}.parquet")
    os.utime(f"{folder}/{number}.parquet", (1_600_000_000 + number,) * 2)


def feed(spark, folder, schema):
    return feeds.feature_feed(spark, folder, spark.createDataFrame([], schema).schema, files_a_batch=1)


FILES = [
    [("a", day(1), 1), ("b", day(2), 2)],
    [("a", day(3), 3), ("a", day(3), 3)],  # a row that repeats is two rows
    [("b", day(2), 4), ("b", day(5), 5)],  # one is late
    [("a", None, 6)],
    [("c", day(4), 7), ("c", day(9), 8)],
]


@pytest.mark.parametrize("point", ["before", "after"])
@pytest.mark.parametrize("batch", [0, 2, 4])
def test_failures_around_the_commit(spark, tmp_path, monkeypatch, point, batch):
    """The sink dies once, between its write and the ledger or between the ledger and the stream's own commit."""
    for i, rows in enumerate(FILES):
        put(spark, f"{tmp_path}/in", i, rows, FEED)
    enter, died = sinks.EmittedTable.enter, []

    def dies(self, name, entry):
        if entry["batch"] == batch and not died:
            died.append(batch)
            if point == "after":
                enter(self, name, entry)
            raise RuntimeError("lost")
        enter(self, name, entry)

    monkeypatch.setattr(sinks.EmittedTable, "enter", dies)
    rows = feed(spark, f"{tmp_path}/in", FEED)
    table = sinks.EmittedTable(spark, f"file://{tmp_path}/out", "ts")
    with pytest.raises(Exception, match="lost"):
        table.start(rows).awaitTermination()
    assert table.read(rows.schema).count() == sum(map(len, FILES[: batch + (point == "after")]))
    table.start(rows).awaitTermination()
    table.start(rows).awaitTermination()
    got = sorted((r.k, r.ts, r.x, r.late) for r in table.read(rows.schema).where("ts is not null").collect())
    late = {4, 7}
    assert got == sorted((k, ts, x, x in late) for f in FILES for k, ts, x in f if ts)
    assert table.read(rows.schema).where("ts is null").select("x", "late").collect() == [(6, False)]
    assert [e["rows"] for e in table.entries()] == [len(f) for f in FILES] and table.emitted_until() == day(9)


def test_files_that_arrive_later(spark, tmp_path):
    schema = spark.createDataFrame([], FEED).schema
    table = sinks.EmittedTable(spark, f"file://{tmp_path}/out", "ts")
    assert table.emitted_until() is None and table.read(schema).count() == 0
    put(spark, f"{tmp_path}/in", 0, FILES[0], FEED)
    table.start(feed(spark, f"{tmp_path}/in", FEED)).awaitTermination()
    seen = table.emitted_until()
    assert seen == day(2) and table.between(schema, None, day(1)).count() == 1
    for i in (1, 2):
        put(spark, f"{tmp_path}/in", i, FILES[i], FEED)
    table.start(feed(spark, f"{tmp_path}/in", FEED), lambda df: df.where("x <> 3 or k = 'a'")).awaitTermination()
    assert table.between(schema, seen, day(4)).count() == 2 and table.between(schema, day(4), day(20)).select("x").collect() == [(5,)]
    table.write(spark.createDataFrame(FILES[0], FEED), 0)  # a replay by hand changes nothing
    assert table.read(schema).count() == 6


ORDER = "order_id long, ticker string, direction int, opened timestamp, until timestamp, take_price double, stop_price double"
BAR = "ticker string, ts timestamp, low double, high double, close double"


def months(spark, tmp_path, n=12):
    """Orders of 30 days at the start of each of ``n`` months, and a bar a day, one file a month and stream."""
    orders, bars = [], []
    for m in range(n):
        mine = [(10 * m + i, f"t{i}", 1 if i % 2 else -1, day(30 * m + i), day(30 * m + i + 10 + i), 12.0 + i, 8.0 - i) for i in range(4)]
        ticks = [(f"t{i}", day(30 * m + d), 10 - (d * 7 + i + m) % 5, 10.0 + (d * 5 + i + m) % 7, 10.0) for i in range(5) for d in range(30)]
        ticks = [(t, ts, float(lo), hi, c) for t, ts, lo, hi, c in ticks]
        put(spark, f"{tmp_path}/orders", m, mine, ORDER)
        put(spark, f"{tmp_path}/bars", m, ticks, BAR)
        orders += mine
        bars += ticks
    return orders, bars


def run(stream, folder):
    states = []
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    for p in q.recentProgress:
        states.append([s["numRowsTotal"] for s in p["stateOperators"]])
    return q, states


def test_joined_streams_equal_the_batch_and_forget(spark, tmp_path):
    orders, bars = months(spark, tmp_path)
    paths = feeds.streamed_paths(feed(spark, f"{tmp_path}/orders", ORDER), feed(spark, f"{tmp_path}/bars", BAR), "20 days", "3 days")
    _, states = run(paths, f"{tmp_path}/p")
    got = sorted((r.order_id, r.ts) for r in spark.read.parquet(f"{tmp_path}/p/out").collect())
    assert got == sorted((o[0], b[1]) for o in orders for b in bars if o[1] == b[0] and o[3] <= b[1] <= o[4])
    assert max(s[0] for s in states) < 500 < len(orders) + len(bars)  # a few months' rows at most
    old = trade_operators.trade_paths(
        spark.createDataFrame([(o[0], o[1], 1, 1.0, 10.0, o[3].date(), o[4].date(), 1.0, -1.0) for o in orders], "order_id long, ticker string, direction int, amount double, fill_price double, trade_date date, timeout date, take_profit double, stop_loss double"),
        spark.createDataFrame([(b[0], b[1].date(), 10.0, b[2], b[3], b[4], 0.0) for b in bars], "ticker string, date date, open double, low double, high double, close double, dividends double"),
    )
    assert sorted((r.order_id, dt.datetime.combine(r.day, dt.time())) for r in old.collect()) == got


def test_exits_of_joined_streams(spark, tmp_path):
    orders, bars = months(spark, tmp_path)
    out = feeds.streamed_exits(feed(spark, f"{tmp_path}/orders", ORDER), feed(spark, f"{tmp_path}/bars", BAR), "20 days", "3 days")
    run(out, f"{tmp_path}/e")
    got = {r.order_id: (r.closed, r.price, r.cause) for r in spark.read.parquet(f"{tmp_path}/e/out").collect()}
    want = {}
    for oid, ticker, side, opened, until, take, stop in orders:
        for t, ts, low, high, close in sorted(b for b in bars if b[0] == ticker and opened <= b[1] <= until):
            stopped, took = (low <= stop, high >= take) if side > 0 else (high >= stop, low <= take)
            if stopped or took or ts >= until:
                want[oid] = (ts, stop, "stop_loss") if stopped else (ts, take, "take_profit") if took else (ts, close, "timeout")
                break
    mark = min(max(o[3] for o in orders), max(b[1] for b in bars)) - dt.timedelta(days=3)
    sure = {o[0] for o in orders if o[3] + dt.timedelta(days=20) < mark}
    assert sure and got == {k: v for k, v in want.items() if k in sure} and {"stop_loss"} <= {v[2] for v in got.values()}


def test_orders_without_end_and_keys_without_bars(spark, tmp_path):
    put(spark, f"{tmp_path}/orders", 0, [(1, "a", 1, day(1), None, 99.0, 0.0), (2, "none", 1, day(1), day(5), 99.0, 0.0), (3, None, 1, day(1), day(5), 99.0, 0.0)], ORDER)
    put(spark, f"{tmp_path}/bars", 0, [("a", day(i), 1.0, 2.0, 1.5) for i in range(10)] + [(None, day(2), 1.0, 2.0, 1.5), ("a", None, 1.0, 2.0, 1.5)], BAR)
    run(feeds.streamed_paths(feed(spark, f"{tmp_path}/orders", ORDER), feed(spark, f"{tmp_path}/bars", BAR), "4 days", "1 day"), f"{tmp_path}/p")
    assert sorted((r.order_id, r.ts) for r in spark.read.parquet(f"{tmp_path}/p/out").select("order_id", "ts").collect()) == [(1, day(i)) for i in (1, 2, 3, 4, 5)]


def test_a_year_may_be_several_files(spark):
    """large years are written by several tasks, and still each batch is one year, also where a year has few rows."""
    from factorloom.functions.stages import shared_folder
    from factorloom.plans import stream_queries as S

    rows = spark.range(400).select(F.col("id").alias("x"), F.make_date(F.when(F.col("id") < 300, 2019).when(F.col("id") < 301, 2020).otherwise(2021), F.lit(1), F.lit(2)).cast("timestamp").alias("ts")).repartition(5)
    feed, batches, base = S.arriving(rows, "ts", rows_a_file=100), [], f"{shared_folder(spark)}/years-log"
    run = feed.writeStream.foreachBatch(lambda b, i: batches.append((len(b.select(F.input_file_name()).distinct().collect()), sorted(r.x for r in b.collect())))).option("checkpointLocation", base).trigger(availableNow=True).start()
    run.awaitTermination()
    assert batches[0][0] == 3 and [x for _, x in batches] == [list(range(300)), [300], list(range(301, 400))]
