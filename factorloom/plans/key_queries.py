"""Look-ups, random rows and callbacks over side tables, as queries with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factorloom.functions.stages import run_folder
from factorloom.operators import callbacks, sampling
from factorloom.plans import workloads as W
from factorloom.plans.oracles import with_parts
from factorloom.plans.registry import cols, query
from factorloom.sources import keyed
from factorloom.sources.adapters import domain

_TOP = "SELECT order_id FROM trades ORDER BY fill_price DESC, order_id LIMIT 9"


@query(with_parts("trades") + f"""SELECT 'by order' AS asked, order_id, ticker, {cols('amount', 'fill_price', digits=4)} FROM trades WHERE order_id IN ({_TOP})
UNION ALL SELECT 'by date', order_id, ticker, {cols('amount', 'fill_price', digits=4)} FROM trades WHERE trade_date IN (SELECT trade_date FROM trades WHERE order_id IN ({_TOP}))
UNION ALL SELECT 'by table', order_id, ticker, {cols('amount', 'fill_price', digits=4)} FROM trades WHERE order_id IN (SELECT order_id FROM trades WHERE direction < 0 AND amount < -50)""", 4)
def look_ups(spark, d):
    """The dearest trades by order, all trades of their days, and those of a table of orders."""
    path = f"{run_folder(spark)}/keyed-{uuid.uuid4().hex}"
    keyed.write_keyed(W.plain_trades(spark, d), path, ["order_id", "trade_date"], group_bytes=64 << 10)
    every = spark.read.parquet(path)
    orders = [r[0] for r in every.orderBy(F.desc("fill_price"), "order_id").limit(9).select("order_id").collect()]
    top = keyed.look_up(spark, path, "order_id", orders)
    days = [r[0] for r in top.select("trade_date").distinct().collect()]
    shorts = every.where("direction < 0 and amount < -50").select("order_id")
    found = {"by order": top, "by date": keyed.look_up(spark, path, "trade_date", days), "by table": keyed.look_up_all(spark, path, "order_id", shorts)}
    parts = [t.select(F.lit(n).alias("asked"), "order_id", "ticker", "amount", "fill_price") for n, t in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(with_parts("bars") + f"""SELECT date, ticker, {cols('close', digits=4)} FROM bars
QUALIFY row_number() OVER (PARTITION BY last_day(date) ORDER BY md5('7|' || ticker || '|' || CAST(date AS VARCHAR)), ticker, date) <= 20""", 4)
def random_bars(spark, d):
    """Twenty bars of each month by luck, the same on every run."""
    bars = domain(spark, d, "bars").withColumn("month", F.last_day("date"))
    return sampling.random_rows(bars, ["month"], 20, ["ticker", "date"], 7).select("date", "ticker", "close")


_STOPS = """, days AS MATERIALIZED (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, (SELECT count(*) FROM filings f WHERE f.ticker = b.ticker AND f.datekey <= b.date) AS known FROM bars b),
steps AS (SELECT ticker, i, date, close, known, close AS peak, 0 AS stops FROM days WHERE i = 1
  UNION ALL SELECT ticker, i, date, close, known, CASE WHEN fresh OR fired THEN close ELSE greatest(peak, close) END, CASE WHEN fresh THEN 0 WHEN fired THEN stops + 1 ELSE stops END
  FROM (SELECT d.*, s.peak, s.stops, d.known > s.known AS fresh, d.close <= s.peak * 0.7 AS fired FROM steps s JOIN days d ON d.ticker = s.ticker AND d.i = s.i + 1))
SELECT ticker, date, stops, round(close / peak - 1, 6) + 0.0 AS drawdown FROM steps QUALIFY row_number() OVER (PARTITION BY ticker, last_day(date) ORDER BY date DESC) = 1
"""


@query(with_parts("bars", "filings").replace("WITH ", "WITH RECURSIVE ", 1) + _STOPS)
def trailing_stops(spark, d):
    """Firings of a trailing stop since the last filing, at month ends, by a callback over samples, bars and filings."""
    bars = domain(spark, d, "bars")
    return callbacks.trailing_stops(sampling.month_end_samples(bars), bars, domain(spark, d, "filings"))
