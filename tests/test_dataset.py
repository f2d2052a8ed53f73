"""Labels, folds, trades, statistics and assembly over hand-made rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from factorloom.functions import expressions, stages
from factorloom.operators import asof, dataset, folds, fundamentals, labels, reports, signals, statistics, trades
from factorloom.plans.queries import ORACLES, QUERIES
from factorloom.sources import readers

D = dt.date


def day(i):
    return D(2020, 1, 1) + dt.timedelta(i)


@pytest.fixture(scope="module")
def path(spark):
    closes = {"UP": [100, 104, 106, 99], "DOWN": [100, 96, 89, 120], "FLAT": [100, 101, 100, 102], "EDGE": [100, 125, 125, 125]}
    return spark.createDataFrame([(t, day(i), float(c)) for t, v in closes.items() for i, c in enumerate(v)], "ticker string, date date, adj_close double")


def samples(spark, std=0.05, timeout=day(3)):
    return spark.createDataFrame([(t, day(0), timeout, std) for t in ("UP", "DOWN", "FLAT", "EDGE")], "ticker string, date date, timeout date, ewmstd_2y_monthly double")


def test_triple_barrier(spark, path):
    got = {r.ticker: r for r in labels.triple_barrier(samples(spark), path).collect()}
    assert (got["UP"].date_of_touch, got["UP"].primary_label_tbm) == (day(2), 1)  # 104 is under, 106 over
    assert (got["DOWN"].date_of_touch, got["DOWN"].primary_label_tbm) == (day(2), -1)
    assert (got["FLAT"].date_of_touch, got["FLAT"].return_tbm) == (day(3), pytest.approx(0.02))
    wide = {r.ticker: r for r in labels.triple_barrier(samples(spark, 0.25), path).collect()}
    assert wide["EDGE"].date_of_touch == day(3)  # exactly at the barrier is no touch
    bare = {r.ticker: r for r in labels.triple_barrier(samples(spark, None), path).collect()}
    assert all(r.date_of_touch == day(3) for r in bare.values())
    open_ = {r.ticker: r for r in labels.triple_barrier(samples(spark, timeout=None), path).collect()}
    assert open_["UP"].date_of_touch == day(2) and open_["FLAT"].date_of_touch is None


def test_meta_labels(spark, path):
    sided = samples(spark).withColumn("side_prediction", F.when(F.col("ticker") == "DOWN", -1).otherwise(1))
    got = {r.ticker: r for r in labels.meta_labels(sided, path).collect()}
    assert got["DOWN"].m_date_of_touch == day(2) and got["DOWN"].m_return_tbm == pytest.approx(-0.11) and got["DOWN"].m_primary_label_tbm == 0
    adjusted = {r.ticker: r for r in labels.meta_labels(sided, path, side_adjusted=True).collect()}
    assert adjusted["DOWN"].m_return_tbm == pytest.approx(0.11) and adjusted["DOWN"].m_primary_label_tbm == 1


def test_folds(spark):
    rows = spark.createDataFrame([(f"t{i % 3}", day(i // 3 * 2), day(i // 3 * 2 + 5)) for i in range(31)], "ticker string, date date, timeout date")
    got = folds.purged_folds(rows, 4, embargo=0.1).collect()
    sizes = [sum(r.fold == f and r.part == "test" for r in got) for f in range(4)]
    assert sum(sizes) == 31 and max(sizes) - min(sizes) <= 1
    for f in range(4):
        test = [r for r in got if r.fold == f and r.part == "test"]
        train = [r for r in got if r.fold == f and r.part == "train"]
        first, last = min(r.date for r in test), max(r.timeout for r in test)
        assert all(r.timeout <= first or r.date >= last for r in train)
        right = [r.ordinal for r in train if r.date >= last]
        begins = [r.ordinal for r in {x.ordinal: x for x in got}.values() if r.date >= last]
        assert not right or min(right) == min(begins) + 3
    kept = folds.purge_overlaps(rows, rows.where(F.col("date") == day(10))).collect()
    assert all(r.timeout < day(10) or r.date > day(15) for r in kept)


def test_ordinals(spark):
    df = spark.createDataFrame([(day(i * 7 % 50), str(i)) for i in range(200)], "date date, ticker string").repartition(6)
    got = stages.with_ordinal(df, ["date", "ticker"]).collect()
    order = sorted(got, key=lambda r: (r.date, r.ticker))
    assert [r.ordinal for r in order] == list(range(200))


BAR = "ticker string, date date, open double, high double, low double, close double, volume double, dividends double"
TRADE = "order_id long, ticker string, direction int, amount double, fill_price double, trade_date date, timeout date, take_profit double, stop_loss double"


@pytest.mark.parametrize(
    ("direction", "bar", "cause", "price"),
    [
        (1, (100, 120, 80, 110), "stop_loss", 90), (1, (110, 120, 80, 100), "take_profit", 110), (-1, (100, 120, 80, 110), "take_profit", 90), (-1, (110, 120, 80, 100), "stop_loss", 110),
        (1, (100, 112, 95, 101), "take_profit", 110), (-1, (100, 109, 88, 101), "take_profit", 90), (1, (100, 101, 99, 100), "timeout", 103),
    ],
)
def test_exits(spark, direction, bar, cause, price):
    rows = [("A", day(1), *map(float, bar), 1.0, 0.0), ("A", day(2), 103.0, 103.0, 103.0, 103.0, 1.0, 0.0)]
    t = spark.createDataFrame([(1, "A", direction, 10.0 * direction, 100.0, day(1), day(2), 0.1, -0.1)], TRADE)
    r = trades.trade_exits(t, spark.createDataFrame(rows, BAR)).first()
    assert (r.close_cause, r.close_price) == (cause, pytest.approx(price))
    assert r.ret == pytest.approx((price / 100 - 1) * direction)


def test_corporate_exits_and_dividends(spark):
    rows = [("A", day(i), 100.0, 101.0, 99.0, 100.0, 1.0, 2.0 if i == 2 else 0.0) for i in range(1, 5)]
    t = spark.createDataFrame([(1, "A", 1, 10.0, 100.0, day(1), day(30), 0.5, -0.5)], TRADE)
    b = spark.createDataFrame(rows, BAR)
    gone = spark.createDataFrame([("A", day(3), "bankruptcy")], "ticker string, date date, action string")
    r = trades.trade_exits(t, b, gone).first()
    assert (r.close_cause, r.close_price, r.total_dividends, r.total_ret) == ("bankruptcy", 0.0, 20.0, pytest.approx(-0.98))
    active = trades.active_days(t, trades.trade_exits(t, b, gone), b)
    assert active.count() == 3 and trades.dividend_flows(active, 0.25).first().dividends == 15.0


def test_margin(spark):
    cell = spark.createDataFrame([(day(1), -1, -1.0, 10.0, 10.0), (day(2), -1, -1.0, 10.0, 13.0)], "day date, direction int, amount double, fill_price double, close double")
    got = {r.date: r.required_margin for r in trades.daily_values(cell, 0.5, 0.3).collect()}
    assert got == {day(1): pytest.approx(15), day(2): pytest.approx(16.9)}


def test_commission(spark):
    cases = spark.createDataFrame([(90.0, 10.0, 0.35), (10_000.0, 0.001, 0.1), (1_000.0, 15.0, 3.5)], "n double, p double, own double")
    for r in cases.withColumn("fee", trades.commission(F.col("n"), F.col("p"))).collect():
        assert r.fee == pytest.approx(r.own + 0.0002 * r.n + 0.0000207 * r.n * r.p + 0.000735 * r.own + 0.000119 * r.n)
    with pytest.raises(Exception, match="negative"):
        cases.select(trades.commission(F.col("n"), -F.col("p"))).collect()


def test_top_signals_and_allocation(spark):
    rows = [(day(1), i, t, s, c) for i, (t, s, c) in enumerate([("A", -1, 0.9), ("A", -1, 0.8), ("B", 1, 0.7), ("C", 1, 0.95), ("D", -1, 0.6), ("E", 1, 0.99)])]
    sig = spark.createDataFrame(rows, "rebalance date, signal_id long, ticker string, direction int, certainty double")
    used, held = spark.createDataFrame([(3,)], "signal_id long"), spark.createDataFrame([(day(1), "E")], "rebalance date, ticker string")
    got = signals.top_signals(sig, used, held, orders=3, shorts=2).collect()
    assert {r.signal_id for r in got} == {0, 4, 2}
    parts = signals.allocations(signals.top_signals(sig, used, held, 3, 2)).collect()
    assert sum(r.allocation for r in parts) == pytest.approx(1)


def test_statistics(spark):
    assert statistics.t_cdf(1.0, 5) == pytest.approx(0.8183913, abs=1e-6)
    assert statistics.t_quantile(0.95, 10) == pytest.approx(1.8124611, abs=1e-6)
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 5)], "x double")
    r = statistics.t_test(df, "x", 2.0).first()
    assert r.t == pytest.approx(1.4142136) and r.p_value == pytest.approx(0.1151, abs=1e-4) and not r.reject
    hist = {x.bin: x["count"] for x in statistics.return_histogram(df, "x", 2.0).collect()}
    assert hist == {0: 2, 1: 2, 2: 1}
    acc = spark.range(2000).withColumn("y", F.lit(1)).withColumn("p", (F.col("id") % 4 > 0).cast("int"))
    drawn = statistics.bootstrap_accuracy(acc, "y", "p", ["id"], 20, 1_000).collect()
    assert len(drawn) == 20 and all(0.7 < x.accuracy < 0.8 and x.n == 1_000 for x in drawn) and len({x.accuracy for x in drawn}) > 5
    assert not statistics.bootstrap_accuracy(acc.limit(0), "y", "p", ["id"], 3, 5).count()


def test_fundamental_formulas(spark):
    quarters = [D(2018 + i // 4, [3, 6, 9, 12][i % 4], [31, 30, 30, 31][i % 4]) for i in range(8)]
    values = {c: 100.0 for c in readers.FILING_VALUES}
    rows = [("A", q, q + dt.timedelta(40), *[v + (10.0 * i if c in ("netinc", "assets", "revenueusd") else 0) for c, v in values.items()]) for i, q in enumerate(quarters)]
    df = spark.createDataFrame(rows, "ticker string, calendardate date, datekey date, " + ", ".join(f"{c} double" for c in values))
    meta = spark.createDataFrame([("A", "Tobacco", D(2017, 1, 1))], "ticker string, industry string, firstpricedate date")
    got = {r.calendardate: r for r in fundamentals.fundamental_features(df, df, meta).collect()}
    assert got[quarters[0]].bm is None and got[quarters[4]].bm == 1.0
    last = got[quarters[7]]
    assert last.agr == pytest.approx(170 / 130 - 1) and last.roaq == pytest.approx(170 / 160) and last.nincr == 4 and last.sin == 1
    assert last.ps == 6
    assert last.change_sales == 40 and last.roavol == pytest.approx(0.0, abs=1e-7)
    corrected = fundamentals.fundamental_features(df, df, meta, corrected=True).where(F.col("calendardate") == quarters[7]).first()
    assert corrected.chprofitmargin == pytest.approx(0.0)
    adjusted = fundamentals.industry_features(fundamentals.fundamental_features(df, df, meta)).where(F.col("calendardate") == quarters[7]).first()
    assert adjusted.bm_ia == 0 and adjusted.herf == pytest.approx(1)


def test_sizes_and_fill(spark):
    df = spark.createDataFrame([(math.log(x),) for x in (1e6, 50e6 * 1.0001, 1e9, 5e9, 5e10, 1e12)], "mve double").select(dataset.size_class().alias("s"))
    assert [r.s for r in df.collect()] == ["nano", "micro", "small", "mid", "large", "mega"]
    rows = spark.createDataFrame([("a", day(0), "i", "nano", 1.0), ("b", day(0), "i", "nano", 3.0), ("c", day(0), "i", "nano", None), ("d", day(0), "j", "nano", None), ("e", day(0), "j", "mega", None)], "ticker string, date date, industry string, size string, x double")
    by = dataset.statistics_by(rows, ["industry", "size"], ["x"]), dataset.statistics_by(rows, ["size"], ["x"])
    mean = {r.ticker: r.x for r in dataset.impute(rows, ["x"], *by, "mean").collect()}
    assert mean == {"a": 1.0, "b": 3.0, "c": 2.0, "d": 2.0, "e": 0.0}
    one, two = ({r.ticker: r.x for r in dataset.impute(rows.repartition(n), ["x"], *by).collect()} for n in (1, 4))
    assert one == two and one["a"] == 1.0 and one["c"] not in (1.0, 3.0)
    z = spark.range(20_000).select(dataset.hashed_normal(1, F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_merge_keeps_price_side_names(spark):
    p = spark.createDataFrame([("A", day(9), day(0), 9, "x")], "ticker string, date date, datekey date, age int, industry string")
    f = spark.createDataFrame([("A", D(2019, 12, 31), day(0), False, 1.0, "y"), ("A", D(2020, 3, 31), day(0), True, 2.0, "y")], "ticker string, calendardate date, datekey date, is_filled boolean, bm double, industry string")
    r = dataset.merge_features(p, f).first()
    assert (r.age, r.industry, r.industry_sf1, r.bm) == (9, "x", "y", 2.0)
    assert dataset.merge_features(p, f, prefer_original=True).first().bm == 1.0


def test_actions_and_quarters(spark):
    b = spark.createDataFrame([("A", day(5)), ("B", day(9)), ("C", day(9))], "ticker string, date date")
    e = spark.createDataFrame([("A", day(7), "13|42"), ("C", day(2), "131|42"), ("B", day(3), "x|13")], "ticker string, date date, eventcodes string")
    got = {r.ticker: (r.date, r.action) for r in reports.corporate_actions(b, e).collect()}
    assert got == {"A": (day(5), "bankruptcy"), "B": (day(3), "bankruptcy")}
    q = spark.createDataFrame([(D(2020, 3, 31),)], "d date").select(expressions.shift_quarters(F.col("d"), -2).alias("x")).first().x
    assert q == D(2019, 9, 30)
    with pytest.raises(Exception, match="not a quarter end"):
        spark.createDataFrame([(D(2020, 3, 30),)], "d date").select(expressions.shift_quarters(F.col("d"), 1)).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "rf.csv").write_text("DATE,DTB3\n2020-01-01,1.5\n2020-01-02,.\n")
    assert [r.percent for r in readers.read_bill_rates(spark, str(tmp_path / "rf.csv")).collect()] == [1.5, None]
    (tmp_path / "ix.csv").write_text("date,close\n03.01.2020,10\n04.01.2020,\n")
    assert [(r.date, r.close) for r in readers.read_index(spark, str(tmp_path / "ix.csv")).collect()] == [(D(2020, 1, 3), 10.0), (D(2020, 1, 4), None)]
    (tmp_path / "f.csv").write_text("ticker,dimension,calendardate,datekey,assets,ps,roic\nA,ART,2020-03-31,2020-05-01,NaN,7,x\nA,ARQ,2020-03-31,2020-05-01,5,7,1\n")
    r = readers.read_filings(spark, str(tmp_path / "f.csv"), "ART").first()
    assert r.assets is None and r.raw_ps == 7 and r.raw_roic is None and r.netinc is None
    df = spark.createDataFrame([("A", day(0), 1.0), ("B", day(400), 2.0)], "ticker string, date date, x double")
    readers.write_dataset(df, str(tmp_path / "ds"))
    assert [r.ticker for r in readers.read_dataset(spark, str(tmp_path / "ds"), "2021-01-01").collect()] == ["B"]


def test_csv_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,ticker,open,high,low,close,dividends\n2010-01-01,A,10,10.5,9.5,10,2\n2010-01-02,A,x,11,9,inf,1\n")
    first, second = readers.read_prices(spark, str(tmp_path / "p.csv")).orderBy("date").collect()
    assert (first.ticker, first.close, first.dividends, first.volume) == ("A", 10.0, 2.0, None) and second.open is None and second.close is None
    (tmp_path / "m.csv").write_text("table,ticker,industry,sector,siccode,firstpricedate\nSF1,A,Tobacco,Goods,2111,1998-01-02\n")
    m = readers.read_metadata(spark, str(tmp_path / "m.csv")).first()
    assert (m.ticker, m.table, m.siccode, m.firstpricedate) == ("A", "SF1", 2111, D(1998, 1, 2))
    (tmp_path / "e.csv").write_text("ticker,date,eventcodes\nA,2010-01-03,13|42|98\n")
    assert readers.read_events(spark, str(tmp_path / "e.csv")).first().eventcodes == "13|42|98"
    kept = readers.write_stage(spark.range(3), str(tmp_path / "stage"))
    assert kept.count() == 3 and spark.read.parquet(str(tmp_path / "stage")).count() == 3


def test_accounts(spark):
    balances = spark.createDataFrame([(day(0), 100.0, 50.0), (day(1), -200.0, 50.0)], "date date, balance double, margin_account double")
    rates = spark.createDataFrame([(day(0), 0.01), (day(1), 0.01)], "date date, daily double")
    paid = trades.account_interest(balances, rates)
    assert {r.date: r.interest for r in paid.collect()} == {day(0): pytest.approx(1.5), day(1): pytest.approx(-1.5)}
    book = {(r.date, r.kind): r.amount for r in trades.interest_entries(paid).collect()}
    assert book == {(day(0), "interest"): pytest.approx(1.5), (day(1), "account_interest"): pytest.approx(1.5)}
    entries = spark.createDataFrame([(day(0), "charged", 40.0), (day(0), "commission", 1.0), (day(2), "proceeds", 50.0)], "date date, kind string, amount double")
    assert {r.date: r.balance for r in trades.daily_balances(entries, 100.0).collect()} == {day(0): 59.0, day(2): 109.0}


def test_metadata_rows_stay_whole(spark):
    rows = spark.createDataFrame([("A", "x", None, D(2000, 1, 1)), ("A", None, 7, D(1999, 1, 1))], "ticker string, industry string, siccode int, firstpricedate date")
    assert asof.last_rows(rows, ("industry", "siccode")).first() == ("A", "x", None)


def test_quarters_between(spark):
    df = spark.createDataFrame([(D(2019, 9, 30), D(2020, 6, 30)), (D(2020, 3, 31), D(2019, 3, 31))], "a date, b date")
    got = [r.x for r in df.select(expressions.quarter_ends(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [[D(2019, 9, 30), D(2019, 12, 31), D(2020, 3, 31), D(2020, 6, 30)], []]


def test_lags_know_no_later_filing(spark):
    q, public = [D(2019, 3, 31), D(2019, 6, 30), D(2019, 9, 30)], [D(2019, 5, 1), D(2019, 8, 1), D(2019, 11, 1)]
    rows = [("A", c, p, float(i)) for i, (c, p) in enumerate(zip(q, public))] + [("A", q[0], D(2019, 9, 1), 9.0)]
    df = spark.createDataFrame(rows, "ticker string, calendardate date, datekey date, v double")
    for history in (None, df):
        got = {(r.calendardate, r.datekey): (r.q0_v, r.q1_v, r.q2_v, r.has_q2) for r in asof.filing_lags(df, [(history, [0, 1, 2], ["v"], "q")]).collect()}
        assert got == {(q[0], public[0]): (0.0, None, None, False), (q[0], D(2019, 9, 1)): (9.0, None, None, False), (q[1], public[1]): (1.0, 0.0, None, False), (q[2], public[2]): (2.0, 1.0, 9.0, True)}


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_barriers_from_a_carried_price(spark, path):
    """Samples that carry their price have the same labels as those that look it up."""
    bare = samples(spark)
    priced = bare.join(path.select("ticker", "date", "adj_close"), ["ticker", "date"], "left")
    a, b = (labels.triple_barrier(s, path).select(*bare.columns, "date_of_touch", "return_tbm", "primary_label_tbm") for s in (bare, priced.where("adj_close is not null")))
    assert b.count() > 0 and b.exceptAll(a).count() == 0
    plan = labels.triple_barrier(priced, path)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_rounding_is_the_other_engines(spark):
    """F5-F7: doubles next to a half at the last digit compared go the way that the SQL's round takes them."""
    import math
    import random

    import duckdb

    rng = random.Random(3)
    values = [s * x for s in (1, -1) for x in (0.0, 0.5e-6, 1.5e-6, 2.5e-6, 0.49999999999999994e-6, 267277.2993415, 1e15 + 0.5, 4.5e15, 1e299, math.inf, *(rng.randrange(10**12) * 1e-6 + 5e-7 for _ in range(5000)))]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None), (-2, math.nan)], "i int, x double")
    got = {r.i: r.x for r in expressions.rounded(frame, 6).collect()}
    assert got[-1] is None and math.isnan(got[-2])
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert expressions.rounded(spark.createDataFrame([(4187.14,)], "x double"), 12).first().x == 4187.14
    short = [4294967296.07 + i * 1e9 + i / 100 for i in range(500)]
    short = [round(x, 2) for x in short]
    assert [r.x for r in expressions.rounded(spark.createDataFrame([(x,) for x in short], "x double").coalesce(1), 6).collect()] == short
    assert [got[i] for i in range(len(values))] == want and not any(math.copysign(1, got[i]) < 0 for i in range(len(values)) if got[i] == 0)
