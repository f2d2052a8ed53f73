"""Quality reports over filings and bars, source purging and corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BANKRUPT = 13


def purge_tickers(df: DataFrame, filings: DataFrame, source_table: str | None = None) -> DataFrame:
    """Rows of tickers that have a filing; with ``source_table`` also of that metadata table only."""
    kept = df.join(filings.select("ticker").distinct(), "ticker", "left_semi")
    return kept if source_table is None else kept.where(F.col("source_table") == source_table)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, n) of every column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_n").alias("n")) for c in df.columns])).alias("x")).select("x.*")


def gap_report(filings: DataFrame) -> DataFrame:
    """(ticker, gaps_over_1q, gaps_over_4q): period ends in a row more than 100 and 370 days apart; tickers with any."""
    w = Window.partitionBy("ticker").orderBy("calendardate", "datekey")
    gaps = filings.withColumn("_gap", F.datediff("calendardate", F.lag("calendardate").over(w)))
    return gaps.groupBy("ticker").agg(F.count_if(F.col("_gap") > 100).alias("gaps_over_1q"), F.count_if(F.col("_gap") > 370).alias("gaps_over_4q")).where("gaps_over_1q > 0 or gaps_over_4q > 0")


def update_report(filings: DataFrame) -> DataFrame:
    """(ticker, calendardate, count) of periods filed more than once."""
    return filings.groupBy("ticker", "calendardate").count().where(F.col("count") > 1)


def duplicate_datekeys(filings: DataFrame) -> DataFrame:
    """(ticker, repeated): whether a ticker has any datekey twice."""
    return filings.groupBy("ticker").agg((F.count("*") > F.count_distinct("datekey")).alias("repeated"))


def date_relations(filings: DataFrame) -> DataFrame:
    """(ticker, all_later): whether every filing became public after its period."""
    return filings.groupBy("ticker").agg(F.bool_and(F.col("datekey") > F.col("calendardate")).alias("all_later"))


def duplicate_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker", "date").count().where(F.col("count") > 1)


def business_days(filled: DataFrame, index_ticker: str = "snp500") -> DataFrame:
    """(date, is_business_day): whether any ticker but the index can trade."""
    return filled.where(F.col("ticker") != index_ticker).groupBy("date").agg(F.bool_or("can_trade").alias("is_business_day"))


def with_index(bars: DataFrame, index: DataFrame, ticker: str = "snp500") -> DataFrame:
    """Bars with a market index as one more instrument."""
    return bars.unionByName(index.select(F.lit(ticker).alias("ticker"), "date", "close"), allowMissingColumns=True)


def delistings(bars: DataFrame) -> DataFrame:
    """(ticker, date): the last bar of tickers that end before the table does."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("date"))
    return last.join(last.agg(F.max("date").alias("_end")), F.col("date") < F.col("_end")).drop("_end")


def corporate_actions(bars: DataFrame, events: DataFrame) -> DataFrame:
    """(ticker, date, action): the earliest date of any bankruptcy or delisting; bankruptcy if a ticker has one."""
    codes = F.transform(F.split("eventcodes", r"\|"), lambda c: c.try_cast("int"))
    bankrupt = events.where(F.array_contains(codes, BANKRUPT)).select("ticker", "date", F.lit(True).alias("_b"))
    both = bankrupt.unionByName(delistings(bars).withColumn("_b", F.lit(False)))
    return both.groupBy("ticker").agg(F.min("date").alias("date"), F.when(F.bool_or("_b"), "bankruptcy").otherwise("delisted").alias("action"))


def tradeable(filled: DataFrame, actions: DataFrame) -> DataFrame:
    """Add is_tradeable: can_trade, and not bankrupt or delisted by that date."""
    ended = filled.join(actions.select("ticker", F.col("date").alias("_end")), "ticker", "left")
    return ended.withColumn("is_tradeable", F.col("can_trade") & F.coalesce(F.col("date") < F.col("_end"), F.lit(True))).drop("_end")
