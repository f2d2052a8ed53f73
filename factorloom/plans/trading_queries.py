"""Signals, orders, accounts and the statistics of a portfolio, as queries with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.expressions import quarter_ends
from factorloom.functions.stages import staged
from factorloom.operators import reports, signals, statistics, timeseries, trades
from factorloom.plans import workloads as W
from factorloom.plans.oracles import PARTS, r, with_parts
from factorloom.plans.queries import COMMISSION_SQL, forecasts, monthly_pair, PREDICTIONS_SQL, SERIES_SQL
from factorloom.plans.registry import cols, query
from factorloom.sources.adapters import domain


@query(with_parts("rebalanced") + f"SELECT rebalance, signal_id, ticker, direction, {cols('certainty', 'ewmstd')}, features_date FROM rebalanced")
def weekly_signals(spark, d):
    """The surest signals of every Friday that is a business day."""
    return W.weekly_signals(spark, d).select("rebalance", "signal_id", "ticker", "direction", "certainty", "ewmstd", "features_date")


@query(with_parts("rebalanced") + f"""SELECT b.rebalance, b.ticker, b.side AS direction, {cols("certainty", "ewmstd")}, b.date AS features_date FROM candidates b JOIN filled_days f ON f.ticker = b.ticker AND f.date = b.rebalance
LEFT JOIN actions a ON a.ticker = b.ticker WHERE f.can_trade AND coalesce(f.date < a.date, true)""")
def all_signals(spark, d):
    """All signals of those days: the operator with bounds beyond the number of tickers."""
    return W.weekly_signals(spark, d, longs=2**31 - 1, shorts=2**31 - 1).select("rebalance", "ticker", "direction", "certainty", "ewmstd", "features_date")


#: a book of short trades gives the signals that were used and the tickers that are held
_TOP = with_parts("rebalanced", "trades").replace("trades AS (", "plain AS (", 1) + """, book AS (SELECT * FROM plain WHERE direction < 0),
fresh AS (SELECT * FROM rebalanced s WHERE NOT EXISTS (SELECT 1 FROM book k WHERE k.ticker = s.ticker AND k.trade_date = s.features_date + 1) AND NOT EXISTS (SELECT 1 FROM book k WHERE k.ticker = s.ticker AND s.rebalance BETWEEN k.trade_date AND k.timeout)),
firsts AS (SELECT *, direction < 0 AND row_number() OVER (PARTITION BY rebalance, ticker, direction ORDER BY certainty DESC, signal_id) = 1 AS leads FROM fresh),
shorts AS (SELECT rebalance, ticker, signal_id FROM firsts WHERE leads QUALIFY row_number() OVER (PARTITION BY rebalance ORDER BY certainty DESC, signal_id) <= 2),
pool AS (SELECT f.*, false AS short_ FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM shorts s WHERE s.rebalance = f.rebalance AND s.ticker = f.ticker) UNION ALL SELECT f.*, true FROM fresh f JOIN shorts s USING (rebalance, ticker, signal_id)),
top_ AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY rebalance ORDER BY short_ DESC, certainty DESC, signal_id) <= 5),
sized AS (SELECT t.signal_id AS order_id, t.signal_id, t.rebalance AS date, t.ticker, t.direction, t.ewmstd AS take_profit, -t.ewmstd AS stop_loss, CAST(t.rebalance + INTERVAL 1 MONTH AS DATE) AS timeout, v.open AS fill_price, t.certainty, t.features_date,
  least(floor(v.before * 0.1), floor(least(1e9 * 0.05, 5e8 * (t.certainty - 0.5) / sum(t.certainty - 0.5) OVER (PARTITION BY t.rebalance)) / CASE WHEN t.direction < 0 THEN 1.5 ELSE 1 END / v.open)) AS shares
  FROM top_ t JOIN (SELECT ticker, date, open, lag(volume) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars) v ON v.ticker = t.ticker AND v.date = t.rebalance)
"""
_ORDER = f"order_id, signal_id, date, ticker, CAST(shares * direction AS BIGINT) AS amount, direction, {cols('take_profit', 'stop_loss')}, timeout, {r('fill_price', 4)}"


def _allocated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Top signals with their allocations, bars, and a constant portfolio value and funds."""
    bars = staged(domain(spark, d, "bars"))
    made = staged(W.weekly_signals(spark, d, bars))
    book = staged(W.plain_trades(spark, d, bars).where("direction < 0").select("ticker", "trade_date", "timeout"))
    used = made.join(book.select("ticker", F.date_sub("trade_date", 1).alias("features_date")), ["ticker", "features_date"], "left_semi").select("signal_id")
    held = made.select("rebalance", "ticker").distinct().join(book.select("ticker", "trade_date", "timeout"), "ticker").where("rebalance between trade_date and timeout").select("rebalance", "ticker")
    top = staged(signals.allocations(signals.top_signals(made, used, held)))
    return top, bars, top.select(F.col("rebalance").alias("date")).distinct().withColumns({"value": F.lit(1e9), "funds": F.lit(5e8)})


@query(_TOP + f"SELECT {_ORDER} FROM sized WHERE shares * fill_price >= 100")
def sized_orders(spark, d):
    """Orders of the top signals that aren't used or held."""
    return signals.size_orders(*_allocated(spark, d)).withColumn("fill_price", F.round("fill_price", 4))


@query(_TOP + f"SELECT {_ORDER}, 'below the least order' AS error FROM sized WHERE NOT coalesce(shares * fill_price >= 100, false)")
def cancelled_orders(spark, d):
    """The others."""
    return signals.cancelled_orders(*_allocated(spark, d)).withColumn("fill_price", F.round("fill_price", 4))


_HISTORY = _TOP + ", trades AS (SELECT order_id, ticker, direction, shares * direction AS amount, fill_price, date AS trade_date, timeout, take_profit, stop_loss FROM sized WHERE shares * fill_price >= 100)\n, " + ",\n".join(PARTS[n] for n in ("paths", "exits"))
_CLOSED = ["close_price", "ret", "total_ret", "proceeds", "pnl"]


@query(_HISTORY + f"SELECT t.order_id, s.signal_id, s.features_date, {cols('s.certainty').replace('AS s.', 'AS ')}, t.ticker, t.direction, CAST(t.amount AS BIGINT) AS amount, t.trade_date, t.timeout, e.close_date, e.close_cause, {', '.join(r(f'e.{c}', 4, c) for c in _CLOSED)} FROM trades t JOIN sized s USING (order_id) LEFT JOIN exits e USING (order_id)", 6)
def trade_history(spark, d):
    """Every trade with its order, signal and exit, as one flat table."""
    top, bars, funds = _allocated(spark, d)
    orders = staged(signals.size_orders(top, bars, funds))
    opened = orders.withColumnRenamed("date", "trade_date")
    exits = trades.trade_exits(opened, bars, reports.corporate_actions(bars, domain(spark, d, "corp_events")))
    out = trades.trade_history(opened, exits, orders, top)
    return out.select("order_id", "signal_id", "features_date", "certainty", "ticker", "direction", "amount", "trade_date", "timeout", "close_date", "close_cause", *[F.round(c, 4).alias(c) for c in _CLOSED])


_BOOK = with_parts("active", "rates") + f""", fees AS (SELECT trade_date AS date, {COMMISSION_SQL} AS commission, CASE WHEN direction > 0 THEN amount * fill_price ELSE 0 END AS charged FROM trades),
days AS (SELECT day AS date, sum(CASE WHEN direction < 0 THEN close * abs(amount) * (1 + CASE WHEN close <= fill_price THEN 0.5 ELSE 0.3 END) ELSE 0 END) AS margin, sum(CASE WHEN direction < 0 THEN abs(amount) * fill_price * (pow(1.0025, 1.0 / 360) - 1) ELSE 0 END) AS short_interest,
         sum(CASE WHEN direction > 0 THEN dividends * abs(amount) * 0.75 ELSE 0 END) AS dividends, sum(CASE WHEN direction < 0 THEN dividends * abs(amount) * 0.75 ELSE 0 END) AS short_dividends FROM active GROUP BY day),
closed AS (SELECT e.close_date AS date, e.proceeds FROM exits e),
flows AS (SELECT date, -commission - charged AS cash FROM fees UNION ALL SELECT date, proceeds FROM closed UNION ALL SELECT date, dividends - short_dividends - short_interest FROM days),
balances AS (SELECT date, 1e6 + sum(sum(cash)) OVER (ORDER BY date) AS balance FROM flows GROUP BY date),
interests AS (SELECT b.date, (b.balance + coalesce(m.margin, 0)) * (pow(1 + q.rate, 1.0 / 91) - 1) AS interest FROM balances b JOIN rates q USING (date) LEFT JOIN days m USING (date))
"""


def _accounts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries (date, kind, amount) of the plain trades' cash flows, and (date, balance, margin_account)."""
    opened, exits, active, _ = W.trade_book(spark, d)
    active = staged(active.select("day", "direction", "amount", "fill_price", "close", "dividends"))
    entries = staged(trades.cash_entries(opened, exits, active))
    margin = trades.daily_values(active).select("date", F.col("required_margin").alias("margin_account"))
    return entries, trades.daily_balances(entries, 1e6).join(margin, "date", "left").fillna(0.0, ["margin_account"])


@query(_BOOK + f"SELECT date, {r('interest', 4)} FROM interests", 4)
def account_interest(spark, d):
    """Interest on each day's balance and margin account."""
    return trades.account_interest(_accounts(spark, d)[1], timeseries.interest(timeseries.daily_rates(domain(spark, d, "bills"))))


_KINDS = {
    "commission": "SELECT date, commission AS v FROM fees", "slippage": "SELECT date, 0.0 FROM fees", "charged": "SELECT date, charged FROM fees", "margin_interest": "SELECT date, short_interest FROM days", "account_interest": "SELECT date, -interest FROM interests WHERE interest < 0",
    "short_dividends": "SELECT date, short_dividends FROM days", "short_losses": "SELECT date, -proceeds FROM closed WHERE proceeds < 0", "dividends": "SELECT date, dividends FROM days", "interest": "SELECT date, interest FROM interests WHERE interest > 0", "proceeds": "SELECT date, proceeds FROM closed WHERE proceeds > 0",
}


@query(_BOOK + ", e AS (" + " UNION ALL ".join(f"SELECT date, '{k}' AS kind, v FROM ({s.replace('SELECT date, ', 'SELECT date, ', 1)}) AS x(date, v)" for k, s in _KINDS.items()) + ") SELECT coalesce(CAST(date AS VARCHAR), 'total') AS date, " + ", ".join(r(f"coalesce(sum(v) FILTER (WHERE kind = '{k}'), 0)", 5, k) for k in _KINDS) + " FROM e GROUP BY ROLLUP (date)", 5)
def account_ledger(spark, d):
    """Costs and income of every day by kind, with their totals."""
    entries, balances = _accounts(spark, d)
    paid = trades.account_interest(balances, timeseries.interest(timeseries.daily_rates(domain(spark, d, "bills"))))
    entries = entries.unionByName(trades.interest_entries(paid))
    return trades.ledger(entries, list(trades.LEDGER)).withColumn("date", F.coalesce(F.col("date").cast("string"), F.lit("total")))


@query(with_parts("bars") + f", i AS (SELECT 'snp500' AS ticker, date, avg(close) AS close FROM bars GROUP BY date) SELECT ticker, date, {r('close', 4)}, {r('volume', 4)} FROM (SELECT ticker, date, close, volume FROM bars UNION ALL SELECT ticker, date, close, NULL FROM i)", 4)
def bars_with_index(spark, d):
    """Bars with the mean close of all tickers as a market index."""
    bars = domain(spark, d, "bars")
    return reports.with_index(bars, bars.groupBy("date").agg(F.avg("close").alias("close"))).select("ticker", "date", "close", "volume")


@query(with_parts("customer_filings") + "SELECT ticker, CAST(last_day(CAST(unnest(generate_series(date_trunc('month', min(calendardate)), date_trunc('month', max(calendardate)), INTERVAL 3 MONTH)) AS DATE)) AS DATE) AS calendardate FROM customer_filings GROUP BY ticker")
def quarter_sequence(spark, d):
    """Every quarter end from a ticker's first filing to its last."""
    spans = domain(spark, d, "customer_filings").groupBy("ticker").agg(F.min("calendardate").alias("a"), F.max("calendardate").alias("b"))
    return spans.select("ticker", F.explode(quarter_ends(F.col("a"), F.col("b"))).alias("calendardate"))


_CDF = "(0.5 + {x} / 6000.0 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * k * pow(1 + pow({x} * i / 2000.0, 2) / v, -(v + 1) / 2))))"
_TEST = SERIES_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT count(portfolio) AS n, count(portfolio) - 1.0 AS v, avg(portfolio) / (stddev_samp(portfolio) / sqrt(count(portfolio))) AS t FROM pair),
w AS (SELECT *, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) AS k FROM s),
q AS (SELECT 0 AS step, v, k, CAST(0 AS DOUBLE) AS low, CAST(20 AS DOUBLE) AS high FROM w UNION ALL SELECT step + 1, v, k, CASE WHEN {_CDF.format(x='((low + high) / 2)')} < 0.95 THEN (low + high) / 2 ELSE low END, CASE WHEN {_CDF.format(x='((low + high) / 2)')} < 0.95 THEN high ELSE (low + high) / 2 END FROM q WHERE step < 45)
SELECT n, {r('t')}, {r('low', 6, 'critical')}, {r(f"1 - {_CDF.format(x='t')}", 6, 'p_value')}, 1 - {_CDF.format(x='t')} < 0.05 AS reject FROM w, (SELECT low FROM q WHERE step = 45)"""


@query(_TEST)
def mean_return_test(spark, d):
    """One-sided test of the mean monthly return of the portfolio."""
    return statistics.t_test(monthly_pair(spark, d), "portfolio")


@query(PREDICTIONS_SQL + """, n AS (SELECT row_number() OVER (ORDER BY date, ticker) - 1 AS ordinal, count(*) OVER () AS size, CAST(l = p AS INT) AS ok FROM y),
picks AS (SELECT draw, CAST('0x' || substr(md5('0|' || draw || '|' || pick), 1, 15) AS BIGINT) % (SELECT max(size) FROM n) AS ordinal FROM (SELECT unnest(range(1, 201)) AS draw), (SELECT unnest(range(1, 3001)) AS pick))
SELECT CAST(draw AS INT) AS draw, """ + r("avg(ok)", 6, "accuracy") + ", count(*) AS n FROM picks JOIN n USING (ordinal) GROUP BY draw")
def bootstrap_accuracy(spark, d):
    """Accuracy of 200 samples of 3,000 forecasts, drawn with replacement."""
    return statistics.bootstrap_accuracy(forecasts(spark, d), "l", "p", ["date", "ticker"])
