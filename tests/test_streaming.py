"""Streaming operators over files that arrive one after the other."""

import datetime as dt

import pandas as pd
import pytest

from factorloom.plans.queries import drained
from factorloom.streaming import feeds

T = dt.datetime


def at(day, hour=0):
    return T(2020, 1, 1) + dt.timedelta(days=day, hours=hour)


def stream(spark, folder, files, schema):
    """One file a batch."""
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(f"{folder}/{i}.parquet")
    # each write is a folder of one file: move the files side by side, in order of time
    import os
    import shutil

    os.makedirs(f"{folder}/in")
    for i in range(len(files)):
        part = next(f for f in os.listdir(f"{folder}/{i}.parquet") if f.endswith(".parquet"))
        shutil.copy(f"{folder}/{i}.parquet/{part}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))
    return feeds.feature_feed(spark, f"{folder}/in", df.schema, files_a_batch=1)


EVENT = "ticker string, ts timestamp, kind string, price double, order_id long, direction int, take_profit double, stop_loss double, timeout timestamp"


def order(ticker, ts, price, oid, direction=1, until=at(20)):
    return (ticker, ts, "order", price, oid, direction, 0.1, -0.1, until)


def price(ticker, ts, value):
    return (ticker, ts, "price", value, None, None, None, None, None)


def test_exits(spark, tmp_path):
    first = [order(t, at(0), 100.0, i) for i, t in enumerate(["stop", "take", "ended", "quiet", "silent", "open"])] + [order("short", at(0), 100.0, 6, -1)]
    first += [order(t, at(0), 100.0, i, until=at(3)) for i, t in ((7, "ended"), (8, "quiet"), (9, "silent"))]
    first += [price("stop", at(1), 89.0), price("stop", at(2), 120.0), price("take", at(1), 95.0), price("short", at(1), 111.0), price("quiet", at(1), 95.0), price("quiet", at(2), 105.0), price("take", at(1), -5.0)]
    second = [price("take", at(2), 111.0), price("ended", at(3), 104.0), price("open", at(9), 101.0)]
    third = [price("quiet", at(4), 50.0), price("open", at(10), 102.0)]  # the first of these comes later than the watermark allows
    got = drained(feeds.monitor_exits(stream(spark, str(tmp_path), [first, second, third], EVENT)))
    rows = {r.order_id: (r.ticker, r.close_ts, r.close_price, r.close_cause) for r in got.collect()}
    assert rows == {
        0: ("stop", at(1), 89.0, "stop_loss"), 1: ("take", at(2), 111.0, "take_profit"), 6: ("short", at(1), 111.0, "stop_loss"),
        7: ("ended", at(3), 104.0, "timeout"), 8: ("quiet", at(3), 105.0, "timeout"), 9: ("silent", at(3), 100.0, "timeout"),
    }
    rets = {r.order_id: r.ret for r in got.collect()}
    assert rets[6] == pytest.approx(-0.11) and rets[8] == pytest.approx(0.05) and rets[9] == 0


def test_bars_and_statistics(spark, tmp_path):
    ticks = [("A", at(i // 4, i % 4 * 5), float(10 + i % 7), 1.0) for i in range(120)]
    late = [("A", at(1), 999.0, 1.0)]
    files = [ticks[:80], ticks[80:], late]
    bars = drained(feeds.tumbling_bars(stream(spark, str(tmp_path), files, "ticker string, ts timestamp, price double, volume double"))).orderBy("start").collect()
    frame = pd.DataFrame(ticks, columns=["ticker", "ts", "price", "volume"])
    frame["start"] = pd.to_datetime((frame["ts"] - pd.Timestamp(0)) // pd.Timedelta(days=7) * pd.Timedelta(days=7) + pd.Timestamp(0))
    want = frame.groupby("start")["price"].agg(["first", "max", "min", "last", "count"])
    want = want[want.index + pd.Timedelta(days=9) <= frame["ts"].max()]
    assert [(r.start, r.open, r.high, r.low, r.close, r.volume) for r in bars] == [(d, *v[:4], float(v[4])) for d, v in zip(want.index, want.to_numpy())]
    assert len(bars) >= 3
