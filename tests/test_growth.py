"""Work that must not grow with rows where it needn't: copies, shuffles, files written."""

from datetime import date as day

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factorloom.operators import dataset, profiles, sampling, timeseries
from factorloom.plans import trading_queries
from factorloom.plans import workloads as W


def test_walk_copies_once_a_batch():
    days = np.arange(5000, dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(days).cast(pa.date32()), pa.array(days - days % 90).cast(pa.date32()), pa.array(days)], names=["date", "datekey", "x"])
    got = list(sampling.walk_batches(iter([batch.slice(0, 2500), batch.slice(2500)]), 20))
    assert sum(b.num_rows for b in got) > 100 and len(got) <= 6  # two copies, and the days held at the ends


def test_means_by_date_leave_the_bars_where_they_are(spark):
    bars = spark.range(3_000_000).selectExpr("cast(id % 1000 as string) as ticker", "date_add(date '2000-01-01', cast(id div 1000 as int)) as date", "'x' as industry", "cast(id as double) as mom1w", "cast(id as double) as mom12m_actual")
    for df in (timeseries.market_return(bars), timeseries.industry_momentum(bars)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_month_ends_are_the_month_end_samples(spark):
    rows = [(t, d) for t, d in [("a", "2020-01-30"), ("a", "2020-01-31"), ("a", "2020-03-02"), ("b", "2020-01-05"), ("b", "2021-01-06"), ("a", None), (None, "2020-01-01")]]
    bars = spark.createDataFrame(rows, "ticker string, date string").withColumn("date", F.col("date").cast("date"))
    ends = sampling.with_month_ends(bars)
    pairs = lambda df: sorted((r.ticker or "", str(r.date)) for r in df.collect())
    assert pairs(ends.where("month_end")) == pairs(sampling.month_end_samples(bars)) and ends.where("month_end is null").count() == 0


def test_distinct_counts_of_large_slices_are_exact(spark):
    df = spark.range(40_000).selectExpr("cast(id % 20000 as string) as who", "date '2020-01-31' as month", "cast(id % 2 as string) as g")
    spans = spark.createDataFrame([("s", day(2020, 1, 1), day(2020, 12, 31))], "span string, first date, last date")
    assert {r.g: r.n for r in profiles.exact_over(df, "who", spans, "month", ["g"]).collect()} == {"0": 10_000, "1": 10_000}


def test_accounts_make_bars_once(spark):
    entries, balances = trading_queries._accounts(spark, "/root/testdata/sf0.001")
    book = W.trade_book(spark, "/root/testdata/sf0.001")
    assert not any("lineitem" in f for df in (entries, balances, *book) for f in df.inputFiles())


def test_statistics_take_one_aggregate_for_all_features(spark):
    df = spark.createDataFrame([("a", 1, 2.0, None), ("a", 3, None, None), (None, 5, 1.0, None)], "k string, x int, y double, z double")
    got = dataset.statistics_by(df, ["k"], ["x", "y", "z"])
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("partial_avg(") == 1
    assert {(r.k, r.feature): (r["mean"], r.n) for r in got.collect()} == {("a", "x"): (2.0, 2), ("a", "y"): (2.0, 1), ("a", "z"): (None, 0), (None, "x"): (5.0, 1), (None, "y"): (1.0, 1), (None, "z"): (None, 0)}


def test_rows_on_sampled_days(spark):
    rows = spark.createDataFrame([("a", "2020-01-01", 1), ("a", "2020-01-01", 2), ("a", "2020-01-02", 3), ("b", "2020-01-01", 4)], "ticker string, date string, x int").withColumn("date", F.col("date").cast("date"))
    assert sorted(r.x for r in sampling.on_days(rows, rows.where("x = 1 or x = 2")).collect()) == [1, 2]


def test_sampled_bars_write_wide_columns_for_samples_only(spark, monkeypatch):
    """F1, F3, F8-F10: no table of all bars carries what samples alone need, and the marked days are those that the walk samples."""
    from factorloom.plans import workloads as W

    d = "/root/testdata/sf0.001"
    bars = W.sampled_bars(spark, d)
    assert bars.columns == ["ticker", "date", "industry", "adj_close", "mom1w", "mom12m_actual", "sample"]
    known = W.known_bars(spark, d).select("ticker", "date", "datekey")
    want = sorted((r.ticker, r.date) for r in sampling.sample_at_filings(known).collect())
    assert sorted((r.ticker, r.date) for r in bars.where("sample is not null").select("ticker", "date").collect()) == want and bars.count() == known.count()
