"""Readers and writers of the domain tables. Schemas are explicit; unreadable values become null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.expressions import no_nan

PRICES = "ticker string, date date, open double, high double, low double, close double, volume double, dividends double"
METADATA = "ticker string, `table` string, industry string, sector string, siccode int, firstpricedate date"
EVENTS = "ticker string, date date, eventcodes string"
#: numeric columns of a filing that features use
FILING_VALUES = [
    "assets", "assetsavg", "assetsc", "capex", "cashneq", "cashnequsd", "cor", "debtc", "debtnc", "depamor", "ebit", "equity", "equityusd",
    "intangibles", "intexp", "invcap", "inventory", "investmentsc", "liabilities", "liabilitiesc", "marketcap", "ncfo", "netinc", "opinc",
    "payables", "ppnenet", "receivables", "revenueusd", "rnd", "sgna", "sharefactor", "sharesbas", "tangibles", "taxexp",
]


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, columns taken by name and cast; what doesn't parse is null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    wanted = spark.createDataFrame([], schema).schema
    cols = [F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return no_nan(raw.select(*cols))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars; a missing volume or dividends column is null."""
    return _csv(spark, path, PRICES)


def read_filings(spark: SparkSession, path: str, dimension: str | None = None) -> DataFrame:
    """Filings of one dimension (ART, ARQ) or all, with the source's own ps and roic as raw_ps and raw_roic."""
    fields = ", ".join(["ticker string, dimension string, calendardate date, datekey date", *(f"{c} double" for c in [*FILING_VALUES, "ps", "roic"])])
    df = _csv(spark, path, fields).withColumnsRenamed({"ps": "raw_ps", "roic": "raw_roic"})
    return df.where(F.col("dimension") == dimension) if dimension else df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, METADATA)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, EVENTS)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(date, close) of an index file with dd.MM.yyyy dates; rows without a close keep a null."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.expr("try_to_date(date, 'dd.MM.yyyy')").alias("date"), F.expr("try_cast(close as double)").alias("close"))


def read_bill_rates(spark: SparkSession, path: str) -> DataFrame:
    """(date, percent) of a DATE, DTB3 file in which a dot stands for a missing value."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.expr("try_cast(`DATE` as date)").alias("date"), F.expr("try_cast(nullif(DTB3, '.') as double)").alias("percent"))


def write_dataset(df: DataFrame, path: str, date_col: str = "date") -> None:
    """Parquet in one folder a year, so date ranges prune folders; rows of a year are dealt by ticker."""
    df.withColumn("year", F.year(date_col)).repartition("year", "ticker").write.mode("overwrite").partitionBy("year").parquet(path)


def read_dataset(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, date_col: str = "date") -> DataFrame:
    """Rows from start (included) to end (excluded); only the folders of these years are read."""
    df = spark.read.parquet(path)
    if start:
        df = df.where((F.col("year") >= int(start[:4])) & (F.col(date_col) >= F.lit(start).cast("date")))
    if end:
        df = df.where((F.col("year") <= int(end[:4])) & (F.col(date_col) < F.lit(end).cast("date")))
    return df.drop("year")


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Keep a stage's result, so later jobs start from it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def subset(df: DataFrame, tickers: DataFrame | None = None, start: str | None = None, date_col: str = "date") -> DataFrame:
    """Rows of the listed tickers from a date on."""
    out = df if start is None else df.where(F.col(date_col) >= F.lit(start).cast("date"))
    return out if tickers is None else out.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
