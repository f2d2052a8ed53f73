"""All queries over the tables of a folder, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.expressions import no_nan
from factorloom.functions.stages import shared_folder, staged
from factorloom.operators import asof, dataset, folds, fundamentals, labels, reports, sampling, signals, statistics, timeseries, trades
from factorloom.plans import workloads as W
from factorloom.plans.oracles import r, size_sql, trailing_sql, with_parts
from factorloom.plans.registry import ORACLES, QUERIES, cols, query
from factorloom.sources.adapters import domain
from factorloom.sources.readers import FILING_VALUES, subset
from factorloom.streaming import feeds

# sources, filters and quality


@query(with_parts("bars") + f"SELECT ticker, date, {cols('open', 'high', 'low', 'close', 'volume', 'dividends', digits=4)} FROM bars", 4)
def daily_bars(spark, d):
    return domain(spark, d, "bars")


@query(with_parts("bars", "filings", "metadata") + "SELECT ticker, industry, sector, siccode FROM metadata WHERE source_table = 'SF1' AND ticker IN (SELECT ticker FROM filings)")
def purged_metadata(spark, d):
    return reports.purge_tickers(domain(spark, d, "metadata"), domain(spark, d, "filings"), "SF1").select("ticker", "industry", "sector", "siccode")


@query(with_parts("bars") + f"SELECT ticker, date, {cols('close', digits=4)} FROM bars WHERE ticker IN ('3', '5', '8') AND date >= DATE '1999-01-01'", 4)
def sub_dataset(spark, d):
    chosen = spark.createDataFrame([("3",), ("5",), ("8",)], "ticker string")
    return subset(domain(spark, d, "bars"), chosen, "1999-01-01").select("ticker", "date", "close")


@query(with_parts("filings") + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(*) AS n FROM filings" for c in FILING_VALUES) + ")")
def filing_nulls(spark, d):
    return reports.null_counts(domain(spark, d, "filings").select(*FILING_VALUES))


_GAPS = """SELECT ticker, count(*) FILTER (WHERE gap > 100) AS gaps_over_1q, count(*) FILTER (WHERE gap > 370) AS gaps_over_4q
FROM (SELECT ticker, calendardate - lag(calendardate) OVER (PARTITION BY ticker ORDER BY calendardate, datekey) AS gap FROM {0})
GROUP BY ticker HAVING count(*) FILTER (WHERE gap > 100) > 0"""


_FILLED = """, full_ AS (SELECT f.ticker, f.datekey, CAST(last_day(f.calendardate + to_months(CAST(3 * k AS INTEGER))) AS DATE) AS calendardate, k > 0 AS is_filled
FROM (SELECT *, coalesce(lead(q) OVER (PARTITION BY ticker ORDER BY calendardate, datekey) - q, 1) AS gap FROM (SELECT *, year(calendardate) * 4 + quarter(calendardate) - 1 AS q FROM customer_filings)) f, (SELECT unnest(range(0, 4)) AS k)
WHERE k <= greatest(0, least(3, gap - 1)))
"""


@query(with_parts("customer_filings") + _GAPS.format("customer_filings"))
def gap_report(spark, d):
    return reports.gap_report(domain(spark, d, "customer_filings"))


@query(with_parts("customer_filings") + _FILLED + "SELECT ticker, calendardate, datekey, is_filled FROM full_")
def filled_filings(spark, d):
    return asof.fill_quarters(domain(spark, d, "customer_filings")).select("ticker", "calendardate", "datekey", "is_filled")


@query(with_parts("customer_filings") + _FILLED + _GAPS.format("full_"))
def gap_report_after_fill(spark, d):
    return reports.gap_report(asof.fill_quarters(domain(spark, d, "customer_filings")))


@query(with_parts("customer_filings") + _FILLED + "SELECT ticker, calendardate, count(*) AS count FROM full_ GROUP BY ALL HAVING count(*) > 1")
def update_report_after_fill(spark, d):
    return reports.update_report(asof.fill_quarters(domain(spark, d, "customer_filings")))


@query(with_parts("filings") + "SELECT ticker, calendardate, count(*) AS count FROM filings GROUP BY ALL HAVING count(*) > 1")
def update_report(spark, d):
    return reports.update_report(domain(spark, d, "filings"))


@query(with_parts("filings") + "SELECT ticker, count(*) > count(DISTINCT datekey) AS repeated, bool_and(datekey > calendardate) AS all_later FROM filings GROUP BY ticker")
def filing_dates_report(spark, d):
    filings = domain(spark, d, "filings")
    return reports.duplicate_datekeys(filings).join(reports.date_relations(filings), "ticker")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_bars(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return reports.duplicate_bars(lines.select(F.col("l_suppkey").cast("string").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")))


@query(with_parts("filled_days") + "SELECT date, bool_or(can_trade) AS is_business_day FROM filled_days GROUP BY date")
def business_days(spark, d):
    return reports.business_days(timeseries.fill_days(domain(spark, d, "bars")))


@query(with_parts("actions") + "SELECT ticker, date, action FROM actions")
def corporate_actions(spark, d):
    return reports.corporate_actions(domain(spark, d, "bars"), domain(spark, d, "corp_events"))


@query(with_parts("filled_days", "actions") + f"SELECT f.ticker, f.date, {cols('close', digits=4)}, can_trade AND coalesce(f.date < a.date, true) AS is_tradeable FROM filled_days f LEFT JOIN actions a USING (ticker)".replace("f.date < a.date", "f.date < a.date"), 4)
def tradeable_days(spark, d):
    bars = domain(spark, d, "bars")
    return reports.tradeable(timeseries.fill_days(bars), reports.corporate_actions(bars, domain(spark, d, "corp_events"))).select("ticker", "date", "close", "is_tradeable")


# as-of joins and time series


@query(with_parts("known") + f"SELECT ticker, date, calendardate, datekey, CAST(age AS INT) AS age, industry, sector, {cols('sharesbas')} FROM known")
def bars_with_filings(spark, d):
    return W.known_bars(spark, d).select("ticker", "date", "calendardate", "datekey", "age", "industry", "sector", "sharesbas")


_PAID = "coalesce((close + coalesce(dividends, 0)) / nullif(close, 0), 1)"
_DIV = "coalesce(product({}) OVER (PARTITION BY ticker ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)".format(_PAID)


@query(with_parts("bars") + "SELECT ticker, date, " + ", ".join(r(f"{c} / {_DIV}", 4, f"adj_{c}") for c in ("open", "high", "low", "close")) + ", " + r(f"close * product({_PAID}) OVER (PARTITION BY ticker ORDER BY date)", 4, "adj_close_forward") + " FROM bars", 4)
def adjusted_prices(spark, d):
    bars = timeseries.adjust_forward(timeseries.adjust_backward(domain(spark, d, "bars")))
    return bars.select("ticker", "date", "adj_open", "adj_high", "adj_low", "adj_close", "adj_close_forward")


_RET = ["mom1w", "mom12m_actual", "mom1m", "mom6m", "mom12m", "mom24m", "mom12m_to_7m", "chmom", "return_1m", "return_2m", "return_3m", "mom1w_ewa_market", "indmom"]


@query(with_parts("priced") + f"SELECT ticker, date, timeout, {cols(*_RET)} FROM priced")
def price_returns(spark, d):
    return W.priced_bars(spark, d, ["timeout", *_RET[:-2]]).select("ticker", "date", "timeout", *_RET)


_TRAIL = ["maxret", "retvol", "std_turn", "dolvol", "turn", "ill", "dy", "mve"]


@query(with_parts("known") + f"SELECT ticker, date, {cols(*_TRAIL)}, {r('std_dolvol', 2)}, {r('zerotrade', 9)} FROM ({trailing_sql()})", 9)
def trailing_statistics(spark, d):
    out = timeseries.trailing_statistics(W.known_bars(spark, d))
    return out.select("ticker", "date", *[F.round(c, 6).alias(c) for c in _TRAIL], F.round("std_dolvol", 2).alias("std_dolvol"), "zerotrade")


@query(with_parts("monthly") + f"SELECT ticker, month, {cols('ewmstd')} FROM ewm")
def monthly_volatility(spark, d):
    return timeseries.monthly_ewm_std(staged(timeseries.adjust_backward(W.known_bars(spark, d)).select("ticker", "date", "adj_close")))


def beta_sql(table: str) -> str:
    return f""", first AS (SELECT ticker, min(date) AS d0, max(date) AS d1 FROM priced GROUP BY ticker),
tue AS (SELECT ticker, CAST(unnest(generate_series(d0 + CAST((9 - isodow(d0)) % 7 AS INT), CAST(d1 AS TIMESTAMP), INTERVAL 7 DAYS)) AS DATE) AS day FROM first
        UNION ALL SELECT ticker, d0 FROM first WHERE isodow(d0) <> 2),
px AS (SELECT ticker, date, mom1w FROM priced WHERE mom1w IS NOT NULL), pm AS (SELECT ticker, date, mom1w_ewa_market AS m FROM priced WHERE mom1w_ewa_market IS NOT NULL),
asked AS (SELECT s.ticker, s.date, CAST(s.date - INTERVAL 24 MONTH AS DATE) AS s0 FROM {table} s),
pts AS (SELECT a.ticker, a.date, t.day FROM asked a JOIN tue t ON t.ticker = a.ticker AND t.day + CAST((8 - isodow(t.day)) % 7 AS INT) <= a.date AND t.day + CAST((8 - isodow(t.day)) % 7 AS INT) > s0 + CAST((8 - isodow(s0)) % 7 AS INT)
        UNION ALL SELECT ticker, date, s0 FROM asked),
val AS (SELECT p.ticker, p.date, px.mom1w AS x, pm.m FROM pts p ASOF LEFT JOIN px ON px.ticker = p.ticker AND px.date <= p.day ASOF LEFT JOIN pm ON pm.ticker = p.ticker AND pm.date <= p.day),
b AS (SELECT ticker, date, covar_samp(x, m) / nullif(var_samp(m) FILTER (WHERE x IS NOT NULL), 0) AS beta, stddev_samp(x - m) AS idiovol FROM val WHERE x IS NOT NULL AND m IS NOT NULL GROUP BY ALL)
"""


@query(with_parts("sampled") + beta_sql("sampled") + f"SELECT s.ticker, s.date, CASE WHEN s.date >= d0 + INTERVAL 24 MONTH THEN {r('b.beta', 5, 'beta').replace(' AS beta', '')} END AS beta, CASE WHEN s.date >= d0 + INTERVAL 24 MONTH THEN {r('b.idiovol', 5, 'idiovol').replace(' AS idiovol', '')} END AS idiovol FROM sampled s JOIN first USING (ticker) LEFT JOIN b ON b.ticker = s.ticker AND b.date = s.date", 5)
def market_beta(spark, d):
    bars = timeseries.market_return(staged(W.returned_bars(spark, d).select("ticker", "date", "mom1w", "month_end")))
    return timeseries.beta(bars.where("month_end").select("ticker", "date"), bars).select("ticker", "date", "beta", "idiovol")


@query(with_parts("filled_days") + f"SELECT ticker, date, can_trade, {cols('close', 'volume', digits=4)} FROM filled_days", 4)
def filled_days(spark, d):
    return timeseries.fill_days(domain(spark, d, "bars")).select("ticker", "date", "can_trade", "close", "volume")


@query(with_parts("rates") + f"SELECT date, {r('rate')}, {r('pow(1 + rate, 1.0 / 91) - 1', 9, 'daily')}, {r('pow(1 + rate, 1.0 / 3) - 1', 9, 'monthly')}, {r('rate', 6, 'three_month')} FROM rates", 9)
def interest_rates(spark, d):
    return timeseries.interest(timeseries.daily_rates(domain(spark, d, "bills"))).select("date", "rate", "daily", "monthly", "three_month")


@query(with_parts("bars") + f"SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS period, {r('arg_min(open, date)', 4, 'open')}, {r('max(high)', 4, 'high')}, {r('min(low)', 4, 'low')}, {r('arg_max(close, date)', 4, 'close')}, {r('sum(volume)', 4, 'volume')} FROM bars GROUP BY ticker, date_trunc('week', date)", 4)
def weekly_bars(spark, d):
    return timeseries.resample(domain(spark, d, "bars"), "week")


@query(with_parts("bars") + f"SELECT ticker, date, {r('close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) - 1', 6, 'cumulative')} FROM bars")
def cumulative_returns(spark, d):
    return timeseries.cumulative_return(domain(spark, d, "bars")).select("ticker", "date", "cumulative")


_FWD = """, ahead AS (SELECT ticker, date, lead(close, 30) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS f FROM filled_days),
fwd AS (SELECT ticker, last_day(date) AS month, arg_max_null(f, date) AS monthly_return FROM ahead GROUP BY ALL HAVING arg_max_null(f, date) IS NOT NULL)
"""


@query(with_parts("filled_days") + _FWD + f"SELECT ticker, month, {cols('monthly_return')} FROM fwd")
def monthly_forward_returns(spark, d):
    return timeseries.monthly_forward_returns(timeseries.fill_days(domain(spark, d, "bars")), "close")


@query(with_parts("bars", "filings") + """, s AS (SELECT ticker, date FROM bars QUALIFY row_number() OVER (PARTITION BY ticker, last_day(date) ORDER BY date DESC) = 1)
SELECT s.ticker, s.date, arg_min({'d': f.datekey, 'c': f.calendardate}, {'o': abs(f.datekey - s.date), 'd': f.datekey, 'c': f.calendardate}).d AS datekey
FROM s JOIN filings f ON f.ticker = s.ticker AND abs(f.datekey - s.date) <= 10 GROUP BY ALL""")
def nearest_filing(spark, d):
    samples = sampling.month_end_samples(domain(spark, d, "bars")).select("ticker", "date")
    return asof.nearest_within(samples, domain(spark, d, "filings").select("ticker", "datekey", "calendardate"), "date", "datekey", 10).select("ticker", "date", "datekey")


# fundamentals

_COUNTS = ["nincr", "rd", "ps"]


@query(with_parts("featured") + f"SELECT ticker, calendardate, datekey, is_filled, sin, {r('company_age')}, ipo, {cols(*[f for f in fundamentals.FEATURES if f not in _COUNTS])}, {', '.join(f'CAST({f} AS INT) AS {f}' for f in _COUNTS)} FROM featured")
def fundamental_features(spark, d):
    f = domain(spark, d, "filings")
    out = fundamentals.fundamental_features(f, f, domain(spark, d, "metadata"))
    return out.select("ticker", "calendardate", "datekey", "is_filled", "sin", "company_age", "ipo", *fundamentals.FEATURES)


@query(with_parts("industries") + f"SELECT ticker, calendardate, datekey, ms, {cols('herf', *fundamentals.ADJUSTED, digits=5)} FROM industries", 5)
def industry_features(spark, d):
    return W.filing_features(spark, d, []).select("ticker", "calendardate", "datekey", "ms", "herf", *fundamentals.ADJUSTED)


# samples, labels, dataset


@query(with_parts("walked") + "SELECT ticker, date, datekey FROM walked JOIN known USING (ticker, date)")
def samples_at_filings(spark, d):
    return sampling.sample_at_filings(staged(W.known_bars(spark, d).select("ticker", "date", "datekey")))


@query(with_parts("sampled") + f"SELECT ticker, date, {cols('ewmstd_2y_monthly', 'adj_close')} FROM sampled", 6)
def month_end_samples(spark, d):
    return W.month_end_features(spark, d).select("ticker", "date", "ewmstd_2y_monthly", "adj_close")


def barrier_sql(table: str, up: float, down: float, side: str) -> str:
    return f""", path AS (SELECT s.ticker, s.date, s.timeout, ewmstd_2y_monthly * {up} AS up, ewmstd_2y_monthly * {down} AS down, p.date AS t, (p.adj_close / s.adj_close - 1) * {side} AS ret, p.adj_close / s.adj_close - 1 AS raw
      FROM {table} s JOIN adj p ON p.ticker = s.ticker AND p.date BETWEEN s.date AND s.timeout),
touch AS (SELECT ticker, date, up, down, least(timeout, min(t) FILTER (WHERE ret > up), min(t) FILTER (WHERE ret < down)) AS touch FROM path GROUP BY ticker, date, up, down, timeout)
"""


_L1 = with_parts("sampled") + barrier_sql("sampled", 1.0, -1.0, "1")


@query(_L1 + f"SELECT ticker, touch.date, touch AS date_of_touch, {r('raw', 6, 'return_tbm')}, CAST(sign(raw) AS INT) AS primary_label_tbm, {r('touch.up', 6, 'take_profit_barrier')}, {r('touch.down', 6, 'stop_loss_barrier')} FROM touch JOIN path ON path.ticker = touch.ticker AND path.date = touch.date AND path.t = touch".replace("SELECT ticker,", "SELECT touch.ticker,"))
def triple_barrier_labels(spark, d):
    samples, bars = W.barrier_pair(spark, d)
    return labels.triple_barrier(samples, bars).select("ticker", "date", "date_of_touch", "return_tbm", "primary_label_tbm", "take_profit_barrier", "stop_loss_barrier")


_L2 = with_parts("sampled") + ", sided AS (SELECT *, CASE WHEN mom1w > 0 THEN 1 ELSE -1 END AS side_prediction FROM sampled)" + barrier_sql("sided", 1.0, -0.8, "side_prediction")


@query(_L2 + f"SELECT touch.ticker, touch.date, touch AS m_date_of_touch, {r('raw', 6, 'm_return_tbm')}, CASE WHEN raw > 0 THEN 1 ELSE 0 END AS m_primary_label_tbm FROM touch JOIN path ON path.ticker = touch.ticker AND path.date = touch.date AND path.t = touch")
def meta_labels(spark, d):
    samples, bars = W.barrier_pair(spark, d)
    sided = samples.withColumn("side_prediction", F.when(F.col("mom1w") > 0, 1).otherwise(-1))
    return labels.meta_labels(sided, bars).select("ticker", "date", "m_date_of_touch", "m_return_tbm", "m_primary_label_tbm")


@query(_L1 + "SELECT industry, CAST(sign(raw) AS INT) AS label, count(*) AS n FROM touch JOIN path ON path.ticker = touch.ticker AND path.date = touch.date AND path.t = touch JOIN metadata m ON m.ticker = touch.ticker GROUP BY ALL")
def label_counts(spark, d):
    out = labels.triple_barrier(*W.barrier_pair(spark, d))
    return out.groupBy("industry", F.col("primary_label_tbm").alias("label")).agg(F.count("*").alias("n"))


@query(with_parts("sampled", "rates") + ", ".join(["SELECT s.ticker, s.date", *(r(f"return_{k}m - rate * {k} / 3", 6, f"erp_{k}m") for k in (1, 2, 3)), "CAST(sign(return_1m - rate / 3) AS INT) AS erp_1m_direction"]) + " FROM sampled s LEFT JOIN rates ON rates.date = s.date")
def excess_returns(spark, d):
    out = labels.excess_returns(W.month_end_features(spark, d), timeseries.daily_rates(domain(spark, d, "bills")))
    return out.select("ticker", "date", "erp_1m", "erp_2m", "erp_3m", "erp_1m_direction")


_MERGED = with_parts("sampled", "featured") + """, once AS (SELECT * FROM featured QUALIFY row_number() OVER (PARTITION BY ticker, datekey ORDER BY calendardate DESC) = 1),
trail AS (""" + trailing_sql() + f"""),
merged AS (SELECT s.ticker, s.date, s.age, s.industry, o.calendardate AS calendardate_sf1, o.bm, o.roaq, o.agr, o.ps, s.mom24m, t.retvol, {size_sql('t.mve')} AS size
  FROM sampled s JOIN trail t ON t.ticker = s.ticker AND t.date = s.date JOIN once o ON o.ticker = s.ticker AND o.datekey = s.datekey)
"""
_CELLS = ["bm", "roaq", "agr", "retvol"]


def _merged(spark, d):
    samples = timeseries.trailing_statistics(W.returned_bars(spark, d)).where("month_end").drop("month_end")
    filings = domain(spark, d, "filings")
    featured = fundamentals.fundamental_features(filings, filings, domain(spark, d, "metadata"))
    return no_nan(dataset.merge_features(samples, featured)).withColumn("size", dataset.size_class())


@query(_MERGED + f"SELECT ticker, date, CAST(age AS INT) AS age, industry, calendardate_sf1, size, {cols(*_CELLS, 'mom24m')}, CAST(ps AS INT) AS ps FROM merged")
def merged_dataset(spark, d):
    return _merged(spark, d).select("ticker", "date", "age", "industry", "calendardate_sf1", "size", *_CELLS, "mom24m", F.col("ps").cast("int").alias("ps"))


def _stats(keys: str, where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{f}' AS feature, {r(f'avg({f})', 6, 'mean')}, {r(f'stddev_samp({f})', 6, 'std')}, count({f}) AS n FROM merged WHERE {where} GROUP BY {keys}" for f in _CELLS)


@query(_MERGED + _stats("size"))
def size_statistics(spark, d):
    return dataset.statistics_by(_merged(spark, d), ["size"], _CELLS)


@query(_MERGED + _stats("industry, size", "mom24m IS NOT NULL AND age <= 180"))
def industry_statistics(spark, d):
    return dataset.statistics_by(dataset.clean(_merged(spark, d), ("mom24m",)), ["industry", "size"], _CELLS)


_FILL = ", ".join(r(f"coalesce(m.{f}, CASE WHEN i.s_{f} IS NOT NULL THEN i.m_{f} WHEN z.s_{f} IS NOT NULL THEN z.m_{f} ELSE 0 END)", 6, f) for f in _CELLS)
_AGGS = ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in _CELLS)


@query(_MERGED + f""", z AS (SELECT size, {_AGGS} FROM merged GROUP BY size), ok AS (SELECT * FROM merged WHERE mom24m IS NOT NULL AND age <= 180 AND size IS NOT NULL),
i AS (SELECT industry, size, {_AGGS} FROM ok GROUP BY ALL) SELECT m.ticker, m.date, {_FILL} FROM ok m LEFT JOIN i USING (industry, size) LEFT JOIN z ON z.size = m.size""")
def imputed_means(spark, d):
    merged = staged(_merged(spark, d).select("ticker", "date", "age", "industry", "size", "mom24m", *_CELLS))
    rows = dataset.clean(merged, ("mom24m",)).where("size is not null")
    return dataset.impute(rows, _CELLS, dataset.statistics_by(rows, ["industry", "size"], _CELLS), dataset.statistics_by(merged, ["size"], _CELLS), "mean").select("ticker", "date", *_CELLS)


# signals and trades

_COMMISSION = "least(greatest(0.35, abs(amount) * 0.0035), abs(amount) * fill_price * 0.01)"
COMMISSION_SQL = f"({_COMMISSION} + abs(amount) * 0.0002 + abs(amount) * fill_price * 0.0000207 + {_COMMISSION} * 0.000735 + abs(amount) * 0.000119)"


@query(with_parts("trades") + f"SELECT order_id, {r(COMMISSION_SQL, 6, 'commission')}, {r('fill_price * (1 + take_profit)', 4, 'take_profit_price')}, {r('fill_price * (1 + stop_loss)', 4, 'stop_loss_price')} FROM trades")
def commissions(spark, d):
    t = trades.barrier_prices(W.plain_trades(spark, d)).withColumn("commission", trades.commission(F.abs("amount"), F.col("fill_price")))
    return t.select("order_id", "commission", F.round("take_profit_price", 4).alias("take_profit_price"), F.round("stop_loss_price", 4).alias("stop_loss_price"))


_EXIT = ["close_price", "ret", "total_ret", "total_dividends", "proceeds", "pnl"]


@query(with_parts("exits") + f"SELECT order_id, close_date, close_cause, {cols(*_EXIT, digits=4)} FROM exits", 4)
def trade_exits(spark, d):
    return W.trade_book(spark, d)[1].select("order_id", "close_date", "close_cause", *_EXIT)


@query(with_parts("paths") + f"SELECT order_id, day, {cols('low_return', 'high_return', 'close_return')} FROM paths")
def trade_paths(spark, d):
    return trades.trade_paths(W.plain_trades(spark, d), domain(spark, d, "bars")).select("order_id", "day", "low_return", "high_return", "close_return")


@query(with_parts("active") + """SELECT day AS date, """ + ", ".join([
    r("sum(CASE WHEN direction < 0 THEN abs(amount) * (fill_price - close) ELSE amount * close END)", 2, "market_value"), r("sum(abs(amount) * close)", 2, "exposure"),
    r("sum(CASE WHEN direction < 0 THEN close * abs(amount) * (1 + CASE WHEN close <= fill_price THEN 0.5 ELSE 0.3 END) ELSE 0 END)", 2, "required_margin"),
    r("sum(CASE WHEN direction < 0 THEN abs(amount) * fill_price * (pow(1.0025, 1.0 / 360) - 1) ELSE 0 END)", 4, "short_interest"), "count(*) AS positions"]) + " FROM active GROUP BY day")
def portfolio_days(spark, d):
    out = trades.daily_values(W.trade_book(spark, d)[2])
    return out.select("date", *[F.round(c, n).alias(c) for c, n in (("market_value", 2), ("exposure", 2), ("required_margin", 2), ("short_interest", 4))], "positions")


@query(with_parts("active") + "SELECT day AS date, " + r("sum(CASE WHEN direction > 0 THEN dividends * abs(amount) * 0.75 ELSE 0 END)", 6, "dividends") + ", " + r("sum(CASE WHEN direction < 0 THEN dividends * abs(amount) * 0.75 ELSE 0 END)", 6, "short_dividends") + " FROM active WHERE dividends <> 0 GROUP BY day")
def dividend_flows(spark, d):
    return trades.dividend_flows(W.trade_book(spark, d)[2])


@query(with_parts("trades") + f", e AS (SELECT trade_date AS date, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS kind, {COMMISSION_SQL} AS amount FROM trades) SELECT coalesce(CAST(date AS VARCHAR), 'total') AS date, " + ", ".join(r(f"coalesce(sum(amount) FILTER (WHERE kind = '{k}'), 0)", 4, f'"{k}"') for k in ("long", "short")) + " FROM e GROUP BY ROLLUP (date)", 4)
def fee_ledger(spark, d):
    t = W.plain_trades(spark, d)
    entries = t.select(F.col("trade_date").alias("date"), F.when(F.col("direction") > 0, "long").otherwise("short").alias("kind"), trades.commission(F.abs("amount"), F.col("fill_price")).alias("amount"))
    return trades.ledger(entries, ["long", "short"]).withColumn("date", F.coalesce(F.col("date").cast("string"), F.lit("total")))


_HIT = "total_ret > 0"
_MONTHS = "(datediff('month', min(trade_date), max(trade_date)) + 1)"


@query(with_parts("exits") + f", c AS (SELECT t.*, e.* EXCLUDE (order_id), {COMMISSION_SQL} AS commission FROM trades t JOIN exits e USING (order_id)) SELECT count(*) AS trades, count(DISTINCT ticker) AS tickers, " + ", ".join([
    r(f"avg(CASE WHEN {_HIT} THEN 1.0 ELSE 0.0 END)", 5, "hit_ratio"), r("avg(CASE WHEN direction > 0 THEN 1.0 ELSE 0.0 END)", 5, "long_ratio"), r(f"avg(total_ret) FILTER (WHERE {_HIT})", 5, "mean_hit"), r(f"avg(total_ret) FILTER (WHERE NOT {_HIT})", 5, "mean_miss"),
    r("max(total_ret)", 5, "max_hit"), r("min(total_ret)", 5, "min_miss"), r("sum(pnl * abs(amount)) FILTER (WHERE direction > 0)", 0, "pnl_long"), r("sum(pnl * abs(amount)) FILTER (WHERE direction < 0)", 0, "pnl_short"),
    r(f"count(*) / {_MONTHS}", 5, "trades_a_month"), r("avg(close_date - trade_date)", 5, "holding_days"), r("sum(commission) / sum(abs(amount) * fill_price)", 5, "fees_a_dollar"), r("sum(commission) / sum(abs(amount))", 5, "fees_a_share"), r("max(abs(amount) * fill_price)", 3, "max_position"),
    *(f"count(*) FILTER (WHERE close_cause = '{c}') AS closed_by_{c}" for c in ("stop_loss", "take_profit", "timeout", "bankruptcy", "delisted"))]) + " FROM c")
def trade_statistics(spark, d):
    opened, exits, _, _ = W.trade_book(spark, d)
    closed = opened.withColumn("commission", trades.commission(F.abs("amount"), F.col("fill_price"))).join(exits, "order_id")
    out = trades.trade_statistics(closed)
    digits = {"pnl_long": 0, "pnl_short": 0, "max_position": 3}
    return out.select(*[F.round(c, digits.get(c, 5)).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])


# portfolio statistics

SERIES_SQL = with_parts("bars", "filled_days") + _FWD + """, traded AS (SELECT ticker, last_day(date) AS month_end, sum(close * volume) AS dollars FROM bars GROUP BY ALL),
pair AS (SELECT month, avg(monthly_return) AS market, sum(monthly_return * coalesce(dollars, 0)) / nullif(sum(coalesce(dollars, 0)), 0) AS portfolio FROM fwd LEFT JOIN traded ON traded.ticker = fwd.ticker AND month_end = last_day(month) GROUP BY month)
"""


def monthly_pair(spark, d):
    """Monthly returns of all tickers: weighted equally (market), and by the dollars traded in the month (portfolio)."""
    bars = domain(spark, d, "bars")
    fwd = timeseries.monthly_forward_returns(timeseries.fill_days(bars), "close").withColumn("month_end", F.last_day("month"))
    traded = bars.groupBy("ticker", F.last_day("date").alias("month_end")).agg(F.sum(F.col("close") * F.col("volume")).alias("dollars"))
    weighed = fwd.where("monthly_return is not null").join(traded, ["ticker", "month_end"], "left").fillna(0.0, ["dollars"])
    portfolio = F.try_divide(F.sum(F.col("monthly_return") * F.col("dollars")), F.sum("dollars"))
    return weighed.groupBy("month").agg(F.avg("monthly_return").alias("market"), portfolio.alias("portfolio"))


@query(SERIES_SQL + "SELECT " + ", ".join(r(e, 6, n) for e, n in (("corr(portfolio, market)", "correlation"), ("avg(portfolio)", "mean"), ("stddev_samp(portfolio)", "std"), ("avg(market)", "mean_market"), ("stddev_samp(market)", "std_market"))) + " FROM pair")
def return_moments(spark, d):
    return statistics.return_moments(monthly_pair(spark, d))


@query(SERIES_SQL + """, m AS (SELECT avg(portfolio) AS a, stddev_samp(portfolio) AS s, stddev_pop(portfolio) AS p FROM pair), k AS (SELECT (a - 0.002) / s AS sharpe, avg(pow((portfolio - a) / p, 3)) AS skew, avg(pow((portfolio - a) / p, 4)) - 3 AS excess FROM pair, m GROUP BY a, s, p)
SELECT """ + cols("sharpe", "skew", "excess") + ", " + r("sharpe + skew / 6 * pow(sharpe, 2) - excess / 24 * pow(sharpe, 3)", 6, "adjusted_sharpe") + " FROM k")
def sharpe_ratio(spark, d):
    return statistics.sharpe(monthly_pair(spark, d), 0.002)


@query(with_parts("bars") + f"SELECT ticker AS name, CAST(max(date) - min(date) AS INT) AS days, {r('arg_max(close, date) / arg_min(close, date) - 1', 6, 'total_return')}, {r('pow(arg_max(close, date) / arg_min(close, date), 365.0 / (max(date) - min(date))) - 1', 6, 'annual_return')} FROM bars GROUP BY ticker")
def performance(spark, d):
    return statistics.performance(domain(spark, d, "bars").withColumnRenamed("ticker", "name"), "close")


@query(with_parts("filled_days") + _FWD + f", l AS (SELECT min(monthly_return) AS low FROM fwd) SELECT CAST(floor((monthly_return - low) / 0.01 + 1e-9) AS BIGINT) AS bin, {r('any_value(low) + floor((monthly_return - low) / 0.01 + 1e-9) * 0.01', 6, 'low')}, count(*) AS count FROM fwd, l GROUP BY floor((monthly_return - low) / 0.01 + 1e-9)")
def return_histogram(spark, d):
    return statistics.return_histogram(timeseries.monthly_forward_returns(timeseries.fill_days(domain(spark, d, "bars")), "close"), "monthly_return", 0.01)


PREDICTIONS_SQL = with_parts("sampled") + """, y AS (SELECT ticker, date, return_1m, mom1w AS f, CASE WHEN return_1m > 0 THEN 1 ELSE 0 END AS l, CASE WHEN mom1w > 0 THEN 1 ELSE 0 END AS p FROM sampled WHERE return_1m IS NOT NULL AND mom1w IS NOT NULL)
"""


def forecasts(spark, d):
    s = W.month_end_features(spark, d).where("return_1m is not null and mom1w is not null")
    return s.select("ticker", "date", "return_1m", F.col("mom1w").alias("f"), (F.col("return_1m") > 0).cast("int").alias("l"), (F.col("mom1w") > 0).cast("int").alias("p"))


@query(PREDICTIONS_SQL + """, c AS (SELECT count(*) FILTER (WHERE l = 1 AND p = 1) AS tp, count(*) FILTER (WHERE l = 0 AND p = 1) AS fp, count(*) FILTER (WHERE l = 0 AND p = 0) AS tn, count(*) FILTER (WHERE l = 1 AND p = 0) AS fn FROM y)
SELECT tp, fp, tn, fn, """ + ", ".join(r(e, 6, n) for e, n in (("(tp + tn) / (tp + fp + tn + fn)", "accuracy"), ("(tp / (tp + fn) + tn / (tn + fp)) / 2", "balanced_accuracy"), ("tp / (tp + fp)", "precision"), ("tp / (tp + fn)", "recall"), ("2 * tp / (2 * tp + fp + fn)", "f1"))) + " FROM c")
def classification_metrics(spark, d):
    return statistics.classification_metrics(forecasts(spark, d), "l", "p")


@query(PREDICTIONS_SQL + "SELECT " + ", ".join(r(e, 6, n) for e, n in (("avg((f - return_1m) * (f - return_1m))", "mse"), ("avg(abs(f - return_1m))", "mae"), ("1 - sum((f - return_1m) * (f - return_1m)) / (var_pop(return_1m) * count(*))", "r2"), ("1 - sum((f - return_1m) * (f - return_1m)) / sum(return_1m * return_1m)", "r2_zero"))) + ", count(*) AS n FROM y")
def regression_metrics(spark, d):
    return statistics.regression_metrics(forecasts(spark, d), "return_1m", "f")


# folds

_FOLDS = with_parts("priced") + """, s AS (SELECT ticker, date, timeout FROM priced QUALIFY row_number() OVER (PARTITION BY ticker, last_day(date) ORDER BY date DESC) = 1),
o AS (SELECT *, row_number() OVER (ORDER BY date, ticker) - 1 AS ordinal, count(*) OVER () AS n FROM s),
w AS (SELECT *, CASE WHEN ordinal < (n % 5) * (n // 5 + 1) THEN ordinal // (n // 5 + 1) ELSE n % 5 + (ordinal - (n % 5) * (n // 5 + 1)) // (n // 5) END AS own FROM o),
b AS (SELECT own AS fold, min(date) AS lo, max(timeout) AS hi FROM w GROUP BY own),
g AS (SELECT fold, min(ordinal) AS right_ FROM b JOIN w ON w.date >= b.hi GROUP BY fold)
SELECT CAST(b.fold AS INT) AS fold, ticker, date, timeout, ordinal, CASE WHEN own = b.fold THEN 'test' ELSE 'train' END AS part FROM w, b LEFT JOIN g ON g.fold = b.fold
WHERE own = b.fold OR timeout <= lo OR ordinal >= right_ + floor(n * 0.01)"""


def _fold_rows(spark, d):
    return sampling.month_end_samples(timeseries.price_returns(timeseries.adjust_backward(W.known_bars(spark, d)))).select("ticker", "date", "timeout")


@query(_FOLDS)
def purged_folds(spark, d):
    return folds.purged_folds(_fold_rows(spark, d), 5, embargo=0.01)


@query(with_parts("priced") + """, s AS (SELECT ticker, date, timeout FROM priced QUALIFY row_number() OVER (PARTITION BY ticker, last_day(date) ORDER BY date DESC) = 1), t AS (SELECT * FROM s WHERE year(date) = 1998)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE s.date <= t.timeout AND s.timeout >= t.date)""")
def purged_overlaps(spark, d):
    rows = staged(_fold_rows(spark, d))
    return folds.purge_overlaps(rows, rows.where(F.year("date") == 1998))


@query(with_parts("bars") + "SELECT date, coalesce(lead(date, CAST(floor((SELECT count(DISTINCT date) FROM bars) * 0.05) AS INT)) OVER (ORDER BY date), max(date) OVER ()) AS embargo FROM (SELECT DISTINCT date FROM bars)")
def embargo_times(spark, d):
    return folds.embargo_times(domain(spark, d, "bars"), 0.05)


# streams, run to the end of what is there


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a streaming query writes until it has read everything, as a table."""
    base = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    events = feeds.feature_feed(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, files="events.parquet")
    return events.where("value is not null").select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


_WEEK = "TIMESTAMP '1970-01-01' + to_days(CAST(7 * floor(epoch(ts) / 604800) AS INTEGER))"


@query(f"""SELECT ticker, start, {cols('open', 'high', 'low', 'close', 'volume')} FROM (SELECT CAST(user_id AS VARCHAR) AS ticker, {_WEEK} AS start, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events WHERE value IS NOT NULL GROUP BY ALL) WHERE start + INTERVAL 9 DAY <= (SELECT max(ts) FROM events WHERE value IS NOT NULL)""")
def stream_weekly_bars(spark, d):
    return drained(feeds.tumbling_bars(_ticks(spark, d))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""SELECT ticker, "end", {cols('maxret', 'retvol')}, n FROM (SELECT ticker, CAST(day AS TIMESTAMP) + INTERVAL 5 DAY AS "end", max(value) AS maxret, stddev_samp(value) AS retvol, count(*) AS n
FROM (SELECT CAST(user_id AS VARCHAR) AS ticker, ts, value, unnest(generate_series(date_trunc('day', ts) - INTERVAL 4 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS day FROM events WHERE value IS NOT NULL) GROUP BY ALL)
WHERE "end" + INTERVAL 2 DAY <= (SELECT max(ts) FROM events WHERE value IS NOT NULL)""")
def stream_sliding_statistics(spark, d):
    return drained(feeds.sliding_statistics(_ticks(spark, d).withColumnRenamed("price", "ret"), "5 days")).withColumn("end", F.col("end").cast("timestamp_ntz"))


_EXITS = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS ticker, ts, event_id, value AS price, event_type IN ('signup', 'purchase') AS opens, CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END AS direction FROM events WHERE value > 0),
o AS (SELECT ticker, ts, event_id AS order_id, price AS fill, direction, ts + INTERVAL 3 DAY AS until FROM e WHERE opens),
p AS (SELECT o.*, e.ts AS moment, e.event_id AS seen, e.price, (e.price / fill - 1) * o.direction AS ret FROM o JOIN e ON e.ticker = o.ticker AND NOT e.opens AND e.ts >= o.ts),
c AS (SELECT *, CASE WHEN moment >= until THEN 'timeout' WHEN ret <= -0.5 THEN 'stop_loss' WHEN ret >= 0.5 THEN 'take_profit' END AS cause FROM p),
x AS (SELECT * FROM c WHERE cause IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY moment, seen) = 1),
l AS (SELECT o.order_id, any_value(o.ticker) AS ticker, any_value(o.until) AS until, any_value(o.fill) AS fill, any_value(o.direction) AS direction, arg_max(p.price, (p.moment, p.seen)) AS price FROM o LEFT JOIN p USING (order_id)
      WHERE o.order_id NOT IN (SELECT order_id FROM x) AND o.until + INTERVAL 2 DAY < (SELECT max(ts) FROM e) GROUP BY o.order_id)
"""


@query(_EXITS + f"""SELECT order_id, ticker, moment AS close_ts, price AS close_price, cause AS close_cause, {cols('ret')} FROM x
UNION ALL SELECT order_id, ticker, until, coalesce(price, fill), 'timeout', {r('(coalesce(price, fill) / fill - 1) * direction', 6, 'ret')} FROM l""")
def stream_exits(spark, d):
    """Trades opened by signups and purchases, closed by later values of the same user."""
    ticks = feeds.feature_feed(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, files="events.parquet")
    opening = F.col("event_type").isin("signup", "purchase")
    events = ticks.select(
        F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.when(opening, "order").otherwise("price").alias("kind"), F.col("value").alias("price"), F.col("event_id").alias("order_id"),
        F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("direction"), F.lit(0.5).alias("take_profit"), F.lit(-0.5).alias("stop_loss"), F.expr("cast(ts as timestamp) + interval 3 days").alias("timeout"),
    )
    return drained(feeds.monitor_exits(events)).withColumn("close_ts", F.col("close_ts").cast("timestamp_ntz"))


# queries of these modules register themselves
from factorloom.plans import dataset_queries, key_queries, model_checks, model_queries, profile_queries, source_queries, stored_queries, stream_queries, trading_queries  # noqa: E402, F401
