"""Readers and reports over files that the queries write themselves from the tables, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.stages import run_folder
from factorloom.operators import reports, timeseries
from factorloom.plans.oracles import with_parts
from factorloom.plans.registry import cols, query
from factorloom.sources import readers
from factorloom.sources.adapters import domain


def written(df: DataFrame) -> str:
    """A table as CSV files with headers, as the readers expect them."""
    path = f"{run_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    df.write.csv(path, header=True)
    return path


_PRICES = ("open", "high", "low", "close", "volume", "dividends")


@query(with_parts("bars") + f"SELECT ticker, date, {cols(*_PRICES, digits=4)} FROM bars", 4)
def prices_from_csv(spark, d):
    """Bars through a CSV file with an unreadable and an unknown column."""
    bars = domain(spark, d, "bars").withColumn("lastupdated", F.lit("n/a"))
    return readers.read_prices(spark, written(bars)).select("ticker", "date", *_PRICES)


@query(with_parts("filings") + f"SELECT ticker, calendardate, datekey, {cols('assets', 'inventory', 'capex', 'taxexp', digits=4)}, CAST(NULL AS DOUBLE) AS raw_ps, round(sharesbas, 4) AS raw_roic FROM filings", 4)
def filings_from_csv(spark, d):
    """The yearly filings of a CSV file that also has quarterly ones, whose own ps can't be read."""
    filings = domain(spark, d, "filings").withColumns({"ps": F.lit("-"), "roic": F.col("sharesbas")})
    both = filings.withColumn("dimension", F.explode(F.array(F.lit("ART"), F.lit("ARQ"))))
    return readers.read_filings(spark, written(both), "ART").select("ticker", "calendardate", "datekey", "assets", "inventory", "capex", "taxexp", "raw_ps", "raw_roic")


@query(with_parts("metadata") + "SELECT ticker, source_table AS \"table\", industry, sector, siccode, firstpricedate FROM metadata")
def metadata_from_csv(spark, d):
    return readers.read_metadata(spark, written(domain(spark, d, "metadata").withColumnRenamed("source_table", "table")))


@query(with_parts("corp_events") + "SELECT ticker, date, eventcodes FROM corp_events")
def events_from_csv(spark, d):
    return readers.read_events(spark, written(domain(spark, d, "corp_events")))


@query(with_parts("rates") + "SELECT date, rate FROM rates")
def bills_from_csv(spark, d):
    """Daily rates from a file of bill rates in which a dot stands for a missing one."""
    bills = domain(spark, d, "bills").select(F.col("date").alias("DATE"), F.coalesce(F.col("percent").cast("string"), F.lit(".")).alias("DTB3"))
    return timeseries.daily_rates(readers.read_bill_rates(spark, written(bills)))


@query(with_parts("bars") + f"SELECT date, {cols('close', digits=4)} FROM (SELECT date, CASE WHEN day(date) = 13 THEN NULL ELSE avg(close) END AS close FROM bars GROUP BY date)", 4)
def index_from_csv(spark, d):
    """An index file with dates as days.months.years and days without a close."""
    index = domain(spark, d, "bars").groupBy("date").agg(F.avg("close").alias("close"))
    file = index.select(F.date_format("date", "dd.MM.yyyy").alias("date"), F.when(F.dayofmonth("date") != 13, F.col("close")).alias("close"))
    return readers.read_index(spark, written(file))


@query(with_parts("bars") + f"SELECT ticker, date, {cols('close', digits=4)} FROM bars WHERE date >= DATE '1996-06-15' AND date < DATE '1998-02-10'", 4)
def dataset_span(spark, d):
    """A span of a table stored in folders by year."""
    path = f"{run_folder(spark)}/dataset-{uuid.uuid4().hex}"
    readers.write_dataset(domain(spark, d, "bars"), path)
    return readers.read_dataset(spark, path, "1996-06-15", "1998-02-10").select("ticker", "date", "close")


_LOOSE = "SELECT CAST(o_custkey AS VARCHAR) AS ticker, last_day(CAST(o_orderdate AS DATE)) AS calendardate, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 180 AS INT) AS datekey FROM orders"


@query(f"SELECT ticker, count(*) > count(DISTINCT datekey) AS repeated, bool_and(datekey > calendardate) AS all_later FROM ({_LOOSE}) GROUP BY ticker")
def order_dates_report(spark, d):
    """The report on dates over orders as filings: some repeat a day, some come before their month ends."""
    day = F.col("o_orderdate").cast("date")
    filings = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("string").alias("ticker"), F.last_day(day).alias("calendardate"), F.date_add(day, F.pmod("o_orderkey", F.lit(180)).cast("int")).alias("datekey"))
    return reports.duplicate_datekeys(filings).join(reports.date_relations(filings), "ticker")


@query(with_parts("bars") + """, weekly AS (SELECT * FROM bars WHERE isodow(date) < 6), days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM weekly)
SELECT date, EXISTS (SELECT 1 FROM weekly WHERE weekly.date = days.date) AS is_business_day FROM days""")
def weekday_business_days(spark, d):
    """Business days of bars from Monday to Friday only: weekends are filled, and are none."""
    weekly = domain(spark, d, "bars").where(F.weekday("date") < 5)
    return reports.business_days(timeseries.fill_days(weekly))
