"""Price operators over hand-made series."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import asof, sampling, timeseries

D = dt.date


def bars(spark, rows):
    return spark.createDataFrame([(t, d, float(c), float(c), float(c), float(c), 100.0, float(v)) for t, d, c, v in rows], "ticker string, date date, open double, high double, low double, close double, volume double, dividends double")


def test_adjusted_return_is_total_return(spark):
    days = [D(2020, 1, 1) + dt.timedelta(i) for i in range(8)]
    closes, paid = [10, 11, 9, 12, 12, 13, 12, 14], [0, 0, 2, 0, 0, 1, 0, 0]
    got = timeseries.adjust_backward(bars(spark, [("A", *x) for x in zip(days, closes, paid)])).orderBy("date").collect()
    shares = 1.0
    for c, p in zip(closes[1:], paid[1:]):
        shares *= (c + p) / c
    assert got[-1].adj_close == 14
    assert got[-1].adj_close / got[0].adj_close == pytest.approx(shares * 14 / 10)
    assert got[0].adj_open == got[0].adj_close
    forward = timeseries.adjust_forward(bars(spark, [("A", *x) for x in zip(days, closes, paid)])).orderBy("date").collect()
    assert forward[-1].adj_close_forward == pytest.approx(14 * shares)


def test_returns_and_labels(spark):
    rows = [("A", D(2020, 1, 1), 10, 0), ("A", D(2020, 1, 8), 11, 0), ("A", D(2020, 1, 31), 12, 0), ("A", D(2020, 3, 2), 15, 0)]
    df = timeseries.price_returns(bars(spark, rows), "close")
    got = {r.date: r for r in df.collect()}
    first, second = got[D(2020, 1, 1)], got[D(2020, 1, 8)]
    assert first.mom1w is None and second.mom1w == pytest.approx(0.1)
    assert first.return_1m == pytest.approx(0.2) and first.return_2m == pytest.approx(0.2)
    assert got[D(2020, 3, 2)].return_1m is None
    assert first.timeout == D(2020, 1, 8) and got[D(2020, 3, 2)].timeout == D(2020, 3, 2)


def test_later_period_beats_amendment_of_older_one(spark):
    filings = spark.createDataFrame([("A", D(2019, 12, 31), D(2020, 2, 1), 1.0, 1.0), ("A", D(2020, 3, 31), D(2020, 5, 1), 2.0, 1.0), ("A", D(2019, 12, 31), D(2020, 6, 1), 3.0, 1.0), ("A", D(2020, 3, 31), D(2020, 6, 5), 4.0, 1.0)], "ticker string, calendardate date, datekey date, sharesbas double, sharefactor double")
    rows = [("A", D(2020, 1, 31), 1, 0), ("A", D(2020, 2, 1), 1, 0), ("A", D(2020, 6, 2), 1, 0), ("A", D(2020, 6, 6), 1, 0), ("B", D(2020, 6, 6), 1, 0)]
    got = asof.attach_filings(bars(spark, rows), filings).orderBy("date").collect()
    assert [(r.date, r.sharesbas, r.age) for r in got] == [(D(2020, 2, 1), 1.0, 0), (D(2020, 6, 2), 2.0, 32), (D(2020, 6, 6), 4.0, 1)]
    assert all(r.datekey <= r.date for r in got)


def test_fill_limit_and_nulls(spark):
    q = [D(2019, 3, 31), D(2019, 9, 30), D(2020, 9, 30), D(2022, 3, 31)]
    df = spark.createDataFrame([("A", c, c + dt.timedelta(30), None if i == 1 else float(i)) for i, c in enumerate(q)], "ticker string, calendardate date, datekey date, v double")
    got = asof.fill_quarters(df).orderBy("calendardate").collect()
    filled = [r.calendardate for r in got if r.is_filled]
    assert filled == [D(2019, 6, 30), D(2019, 12, 31), D(2020, 3, 31), D(2020, 6, 30), D(2020, 12, 31), D(2021, 3, 31), D(2021, 6, 30)]
    assert next(r for r in got if r.calendardate == D(2019, 12, 31)).v is None
    assert next(r for r in got if r.calendardate == D(2019, 6, 30)).datekey == q[0] + dt.timedelta(30)


def test_monthly_ewm_matches_pandas(spark):
    rng = random.Random(4)
    days = [D(2018, 1, 3) + dt.timedelta(i) for i in range(0, 900) if rng.random() < 0.4 and not 400 < i < 480]
    price = [10 + rng.random() * 3 for _ in days]
    got = {r.month: r.ewmstd for r in timeseries.monthly_ewm_std(bars(spark, [("A", d, p, 0) for d, p in zip(days, price)]), "close").collect()}
    s = pd.Series(price, pd.to_datetime(days))
    s = s.reindex(pd.date_range(s.index[0], s.index[-1] + pd.offsets.MonthEnd(0))).ffill()
    want = (s / s.shift(30) - 1).resample("ME").last().ewm(span=24).std()
    assert len(got) == len(want)
    for d, v in want.items():
        mine = got[d.date()]
        assert (mine is None and v != v) or mine == pytest.approx(v, rel=1e-9)


def test_fill_days(spark):
    got = timeseries.fill_days(bars(spark, [("A", D(2020, 2, 27), 5, 0), ("A", D(2020, 3, 1), 6, 0)])).orderBy("date").collect()
    assert [(r.date.day, r.close, r.can_trade) for r in got] == [(27, 5.0, True), (28, 5.0, False), (29, 5.0, False), (1, 6.0, True)]


def test_bill_rates_are_carried(spark):
    bills = spark.createDataFrame([(D(2020, 1, 1), 1.5), (D(2020, 1, 2), None), (D(2020, 1, 4), 2.0)], "date date, percent double")
    assert [r.rate for r in timeseries.daily_rates(bills).orderBy("date").collect()] == [0.015, 0.015, 0.015, 0.02]


def slow_walk(dates, filings, distance):
    """The sampling rules, day by day, with calendar arithmetic of its own."""
    month = lambda d: min(D(d.year + d.month // 12, d.month % 12 + 1, 1) + dt.timedelta(d.day - 1), D(d.year + (d.month + 1) // 12, (d.month + 1) % 12 + 1, 1) - dt.timedelta(1))
    picks = [dates[0]]
    target, before, filing = month(dates[0]), dates[0], filings[0]
    for day, key in list(zip(dates, filings))[1:]:
        if key != filing:
            if picks[-1] > day - dt.timedelta(distance):
                picks.pop()
            picks.append(day)
            target, filing = month(day), key
            continue
        if day == target:
            picks.append(day)
            target = month(target)
        elif day > target:
            picks.append(before if abs(target - before) <= abs(target - day) else day)
            target = month(target)
        before = day
    return sorted(set(picks))


def test_sampling_walk(spark):
    rng = random.Random(7)
    rows = []
    for t in ("A", "B", "C"):
        key = D(2019, 12, 1)
        for i in range(700):
            day = D(2020, 1, 31) + dt.timedelta(i)
            if rng.random() < 0.02:
                key = day
            if rng.random() < 0.6 and not 200 < i < 270:
                rows.append((t, day, key))
    got = sampling.sample_at_filings(spark.createDataFrame(rows, "ticker string, date date, datekey date")).collect()
    for t in ("A", "B", "C"):
        mine = sorted(r.date for r in got if r.ticker == t)
        own = [r for r in rows if r[0] == t]
        assert mine == slow_walk([r[1] for r in own], [r[2] for r in own], 20)


def test_beta_of_a_scaled_market(spark):
    rng = random.Random(1)
    days = [D(2016, 1, 5) + dt.timedelta(i) for i in range(1200) if (i + 1) % 7 < 5]
    market = {d: rng.gauss(0, 0.02) for d in days}
    df = spark.createDataFrame([("A", d, 2 * market[d], market[d]) for d in days], "ticker string, date date, mom1w double, mom1w_ewa_market double")
    got = timeseries.beta(df.where(F.col("date") >= D(2018, 2, 1)).select("ticker", "date"), df).where("beta is not null").collect()
    assert len(got) > 100 and all(r.beta == pytest.approx(2) and r.betasq == pytest.approx(4) for r in got)
    early = timeseries.beta(df.where(F.col("date") < D(2018, 1, 5)).select("ticker", "date"), df)
    assert not early.where("beta is not null").count()


def test_random_rows_repeat(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 4)
    a = {r.id for r in sampling.random_rows(df, ["g"], 3, ["id"], 5).collect()}
    assert len(a) == 12 and a == {r.id for r in sampling.random_rows(df.repartition(7), ["g"], 3, ["id"], 5).collect()}
