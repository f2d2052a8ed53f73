"""Queries over tables stored in buckets and folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.stages import run_folder
from factorloom.operators import asof, timeseries
from factorloom.plans.oracles import with_parts
from factorloom.plans.registry import cols, query
from factorloom.sources import stored
from factorloom.sources.adapters import domain


def store_all(spark: SparkSession, d: str, buckets: int = 16) -> dict[str, DataFrame]:
    """Bars, filings and metadata in buckets by ticker; bars also in folders by year."""
    base = f"{run_folder(spark)}/stored-{uuid.uuid4().hex}"
    bars = domain(spark, d, "bars").withColumn("year", F.year("date"))
    tables = {"bars": (bars, ["date"], "year"), "filings": (domain(spark, d, "filings"), ["datekey"], None), "metadata": (domain(spark, d, "metadata"), [], None)}
    return {n: stored.store(t, f"{base}/{n}", "ticker", order, buckets, folder) for n, (t, order, folder) in tables.items()}


def windows_over(tables: dict[str, DataFrame]) -> DataFrame:
    """As-of filings, metadata, adjustment and returns, all by ticker."""
    known = asof.enrich(asof.attach_filings_listed(tables["bars"].drop("year"), tables["filings"]), tables["metadata"])
    return timeseries.price_returns(timeseries.adjust_backward(known))


_RET = ["adj_close", "mom1w", "mom12m_actual", "mom1m", "mom6m", "mom12m", "mom24m", "chmom", "return_1m", "return_2m", "return_3m"]


@query(with_parts("rets") + f"SELECT ticker, date, timeout, datekey, industry, mom6m - mom12m_to_7m AS chmom, {cols(*[c for c in _RET if c != 'chmom'])} FROM rets".replace("mom6m - mom12m_to_7m AS chmom", "round(mom6m - mom12m_to_7m, 6) + 0.0 AS chmom"))
def stored_returns(spark, d):
    """Returns over stored tables: no shuffle after the tables were written."""
    return windows_over(store_all(spark, d)).select("ticker", "date", "timeout", "datekey", "industry", *_RET)


_FOLDS = "folds AS (SELECT fold, min(date) AS first, max(date) AS last FROM (SELECT date, ntile(6) OVER (ORDER BY date) AS fold FROM (SELECT DISTINCT date FROM bars)) GROUP BY fold)"


def fold_spans(bars: DataFrame, n: int = 6) -> DataFrame:
    """(fold, first, last) of ``n`` folds of equally many trading days; the days are a few thousand rows."""
    days = bars.select("date").distinct().withColumn("fold", F.ntile(n).over(Window.orderBy("date")))
    return days.groupBy("fold").agg(F.min("date").alias("first"), F.max("date").alias("last"))


@query(with_parts("bars") + f", {_FOLDS} SELECT ticker, date, {cols('close', 'volume', digits=4)} FROM bars WHERE EXISTS (SELECT 1 FROM folds WHERE fold IN (2, 5) AND date BETWEEN first AND last)", 4)
def stored_folds(spark, d):
    """Bars of two folds: their years' folders alone are read."""
    bars = store_all(spark, d)["bars"]
    return stored.in_spans(bars, fold_spans(bars).where("fold in (2, 5)")).select("ticker", "date", "close", "volume")
