"""Price series by ticker: adjustment, returns, trailing statistics, beta, fills and calendars.

All windows share the ordering (ticker, date), so Spark shuffles a price table once for all of them.
"Filled" values are the last known ones at a calendar day; they come from range frames, not from a
table with a row for every day, except in ``fill_days``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import change, ratio
from factorloom.functions.stages import staged

FIRST, NOW = Window.unboundedPreceding, Window.currentRow


def _days() -> Window:
    return Window.partitionBy("ticker").orderBy(F.unix_date("date"))


def as_of(value: str, days: int) -> Column:
    """The last known value at the day ``days`` from the row's own (negative: before); null before the first."""
    return F.last(value, ignorenulls=True).over(_days().rangeBetween(FIRST, days))


def adjust_backward(bars: DataFrame) -> DataFrame:
    """Add adj_open, adj_high, adj_low, adj_close: prices over the product of (close + dividends) / close of all later days.

    The frame runs in descending order, so it only grows and one pass serves a ticker.
    """
    later = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(FIRST, -1)
    paid = F.coalesce(ratio(F.col("close") + F.coalesce("dividends", F.lit(0.0)), F.col("close")), F.lit(1.0))
    out = bars.withColumn("_paid", paid).withColumn("_factor", F.coalesce(F.product("_paid").over(later), F.lit(1.0)))
    prices = [c for c in ("open", "high", "low", "close") if c in bars.columns]
    return out.select(*bars.columns, *[(F.col(c) / F.col("_factor")).alias(f"adj_{c}") for c in prices])


def adjust_forward(bars: DataFrame) -> DataFrame:
    """Add adj_close_forward: close times the product of (close + dividends) / close up to its own day."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(FIRST, NOW)
    paid = F.coalesce(ratio(F.col("close") + F.coalesce("dividends", F.lit(0.0)), F.col("close")), F.lit(1.0))
    return bars.withColumn("_paid", paid).withColumn("adj_close_forward", F.col("close") * F.product("_paid").over(w)).drop("_paid")


def price_returns(bars: DataFrame, price: str = "adj_close") -> DataFrame:
    """Add weekly and yearly returns, momentum, one to three month labels and the timeout of a one-month barrier.

    A label is null when the series ends before its day; timeout is the last bar in fewer than thirty days.
    """
    v = {d: as_of(price, d) for d in (0, -7, -30, -182, -212, -365, -730)}
    end = F.max("date").over(Window.partitionBy("ticker"))
    labels = {f"return_{k}m": F.when(F.date_add("date", 30 * k) <= end, change(as_of(price, 30 * k), F.col(price))) for k in (1, 2, 3)}
    cols = {
        "mom1w": change(v[0], v[-7]),
        "mom12m_actual": change(v[0], v[-365]),
        "mom1m": change(v[0], v[-30]),
        "mom6m": change(v[-30], v[-182]),
        "mom12m": change(v[-30], v[-365]),
        "mom24m": change(v[0], v[-730]),
        "mom12m_to_7m": change(v[-212], v[-365]),
        "timeout": F.max("date").over(_days().rangeBetween(0, 29)),
    } | labels
    return bars.withColumns(cols).withColumn("chmom", F.col("mom6m") - F.col("mom12m_to_7m"))


def means_by(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, mean) written to the shared folder: Spark then knows its bytes, and broadcasts it where it would else shuffle all bars by date first."""
    return staged(df.groupBy(*keys).agg(F.avg(value).alias(out)))


def market_return(df: DataFrame, value: str = "mom1w", out: str = "mom1w_ewa_market") -> DataFrame:
    """Add the equally weighted mean over all tickers of a date: an aggregate of one row a date, joined back."""
    return df.join(means_by(df, ["date"], value, out), "date", "left")


def industry_momentum(df: DataFrame, value: str = "mom12m_actual", out: str = "indmom") -> DataFrame:
    """Add the mean of an industry's tickers on a date, by an aggregate joined back; rows without an industry get null."""
    return df.join(means_by(df, ["industry", "date"], value, out), ["industry", "date"], "left")


def monthly_ewm_std(bars: DataFrame, price: str = "adj_close", span: int = 24) -> DataFrame:
    """(ticker, month, ewmstd): exponentially weighted, bias-corrected deviation of month-end one-month returns.

    Month ends are those of the filled series, from the first to the last month of a ticker; the last one stands at its
    calendar month end. Weights (1 - alpha)**age count months with nulls too, which themselves weigh nothing.
    """
    decay = 1 - 2.0 / (span + 1)
    month = F.last_day("date")
    ends = bars.withColumn("mom1m", change(as_of(price, 0), as_of(price, -30)))
    known = bars.groupBy("ticker", month.alias("month")).agg(F.max("date").alias("date"))
    known = known.withColumn("upto", F.coalesce(F.lead("month").over(Window.partitionBy("ticker").orderBy("month")), F.add_months("month", 1)))
    gap = F.greatest(F.lit(1), F.months_between(F.col("upto"), F.col("month")).cast("int"))
    months = known.withColumn("_k", F.explode(F.sequence(F.lit(0), gap - 1))).select("ticker", F.last_day(F.add_months("month", F.col("_k"))).alias("date"), F.lit(True).alias("_end"))
    last = ends.groupBy("ticker").agg(F.max("date").alias("_last"))
    # the value at a month end is of the day itself: filled price then over filled price thirty days before
    points = bars.select("ticker", "date", price, F.lit(False).alias("_end")).unionByName(months.join(last, "ticker").select("ticker", F.least("date", F.last_day("_last")).alias("date"), F.lit(None).cast("double").alias(price), "_end"))
    valued = points.withColumn("x", change(as_of(price, 0), as_of(price, -30))).where("_end").select("ticker", F.col("date").alias("month"), "x")
    order = Window.partitionBy("ticker").orderBy("month")
    upto = order.rowsBetween(FIRST, NOW)
    n = valued.withColumn("i", F.row_number().over(order))
    up = F.when(F.col("x").isNotNull(), F.pow(F.lit(1 / decay), F.col("i")))
    n = n.withColumn("w", F.sum(up).over(upto)).withColumn("w2", F.sum(up * up).over(upto)).withColumn("wx", F.sum(up * F.col("x")).over(upto)).withColumn("wxx", F.sum(up * F.col("x") * F.col("x")).over(upto)).withColumn("known", F.count("x").over(upto))
    mean = F.col("wx") / F.col("w")
    variance = ratio((F.col("wxx") / F.col("w") - mean * mean) * F.col("w") * F.col("w"), F.col("w") * F.col("w") - F.col("w2"))
    return n.select("ticker", "month", F.when(F.col("known") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("ewmstd"))


def attach_ewm_std(samples: DataFrame, monthly: DataFrame, out: str = "ewmstd_2y_monthly") -> DataFrame:
    """Add the deviation of the latest month end strictly before a sample's date."""
    before = F.last_day(F.add_months("date", -1))
    return samples.withColumn("_m", before).join(monthly.select("ticker", F.col("month").alias("_m"), F.col("ewmstd").alias(out)), ["ticker", "_m"], "left").drop("_m")


def trailing_statistics(bars: DataFrame, first_sample: str | None = None) -> DataFrame:
    """Add trailing month, two and three month and year statistics; bars carry sharesbas and sharefactor.

    Spans are calendar intervals up to the row's own date. A statistic is null until its interval has passed since
    ``first_sample`` (a date column; the ticker's first bar by default). Days without volume don't count in ``ill``. Sums over
    more than a month are differences of running sums, so no frame of a year is added up again for every row.
    """
    by_date = "PARTITION BY ticker ORDER BY date RANGE BETWEEN"
    month = f"OVER ({by_date} INTERVAL '1' MONTH PRECEDING AND CURRENT ROW)"

    def span(aggregate: str, n: int) -> str:
        """A sum or count over the last n months."""
        start = f"INTERVAL '{n}' MONTH PRECEDING"
        until, before, at = (f"coalesce({aggregate} OVER ({by_date} {f}), 0)" for f in ("UNBOUNDED PRECEDING AND CURRENT ROW", f"UNBOUNDED PRECEDING AND {start}", f"{start} AND {start}"))
        return f"({until} - {before} + {at})"

    def known_sum(x: str, n: int) -> str:
        """Sum over the last n months; null if all values are."""
        return f"CASE WHEN {span(f'count({x})', n)} > 0 THEN {span(f'sum({x})', n)} END"

    start = F.col(first_sample) if first_sample else F.min("date").over(Window.partitionBy("ticker"))
    day = {
        "_ret": change(F.col("close"), F.col("open")),
        "_dollars": (F.col("open") + F.col("close")) / 2 * F.col("volume"),
        "_turn": ratio(F.col("volume"), F.col("sharesbas")),
        "_sold": F.when(F.col("close") * F.col("volume") > 0, F.col("close") * F.col("volume")),
    }
    df = bars.withColumns(day).withColumn("_ill", ratio(F.abs("_ret"), F.col("_dollars"))).withColumn("_cap", F.col("sharesbas") * F.col("sharefactor") * F.col("close")).withColumn("_start", start)
    root = "sqrt(22D)"
    turnover = f"try_divide(sum(volume) {month}, avg(sharesbas) {month})"
    monthly = {
        "maxret": f"max(_ret) {month}",
        "retvol": f"stddev_samp(_ret) {month}",
        "std_dolvol": f"stddev_samp(_dollars) {month} * {root}",
        "std_turn": f"stddev_samp(_turn) {month} * {root}",
        "zerotrade": f"(count_if(volume = 0) {month} + try_divide(1D, {turnover}) / (11000D / 12)) * 21 / count(*) {month}",
    }
    others = {
        "dolvol": (2, f"ln({known_sum('_sold', 2)})"),
        "turn": (3, f"try_divide({known_sum('volume', 3)} / 3, sharesbas)"),
        "ill": (12, f"try_divide({known_sum('_ill', 12)}, {span('count(_ill)', 12)})"),
        "dy": (12, f"try_divide({known_sum('dividends', 12)}, _cap)"),
    }
    gate = lambda months, e: F.when(F.col("date") >= F.add_months("_start", months), F.expr(e))
    cols = {k: gate(1, e) for k, e in monthly.items()} | {k: gate(m, e) for k, (m, e) in others.items()} | {"mve": F.expr("CASE WHEN _cap > 0 THEN ln(_cap) END")}
    return df.withColumns(cols).drop("_ret", "_dollars", "_turn", "_sold", "_ill", "_cap", "_start")


def weekly_series(df: DataFrame, x: str = "mom1w", market: str = "mom1w_ewa_market") -> DataFrame:
    """(ticker, monday, x, m): the filled values on the first day, a Tuesday, of each week that ends on a Monday."""
    w = _days().rowsBetween(FIRST, NOW)
    filled = df.select("ticker", "date", F.last(x, ignorenulls=True).over(w).alias("x"), F.last(market, ignorenulls=True).over(w).alias("m"))
    until = F.coalesce(F.lead("date").over(Window.partitionBy("ticker").orderBy("date")), F.date_add("date", 1))
    # a bar holds from its day to the next bar's; the Tuesdays in that time, and its own day where it opens the series
    tuesday = F.next_day(F.date_sub("date", 1), "Tue")
    spread = filled.withColumn("until", until).withColumn("first", F.min("date").over(Window.partitionBy("ticker")))
    days = spread.withColumn("day", F.explode(F.when(tuesday < F.col("until"), F.sequence(tuesday, F.date_sub("until", 1), F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))))
    opening = spread.where("date = first and dayofweek(date) <> 3").withColumn("day", F.col("date"))
    return days.unionByName(opening).select("ticker", F.date_add(F.next_day("day", "Mon"), F.when(F.dayofweek("day") == 2, -7).otherwise(0)).alias("monday"), "x", "m")


def beta(samples: DataFrame, bars: DataFrame, years: int = 2, x: str = "mom1w", market: str = "mom1w_ewa_market") -> DataFrame:
    """Add beta, betasq and idiovol over the weeks of ``years`` years up to each sample, through running sums.

    The first, cut week of the span stands at its own first day. Sums of x, m, xm and squares are taken twice per
    sample, at its date and at the start of its span, and subtracted: no pairs of samples and weeks. Points
    need both values; all three are null in the first ``years`` of a ticker.
    """
    terms = {"n": F.lit(1.0), "sx": F.col("x"), "sm": F.col("m"), "sxm": F.col("x") * F.col("m"), "smm": F.col("m") * F.col("m"), "sdd": (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))}
    key = samples.select("ticker", "date").distinct().withColumn("_s", F.add_months("date", -12 * years))

    def summed(df: DataFrame) -> DataFrame:
        both = F.col("x").isNotNull() & F.col("m").isNotNull()
        return df.withColumns({k: F.when(both, t) for k, t in terms.items()})

    closing = F.next_day(F.date_sub("_s", 1), "Mon")
    asks = key.select("ticker", "date", F.lit(1).alias("_ask"), F.col("date").alias("_of")).unionByName(key.select("ticker", closing.alias("date"), F.lit(-1).alias("_ask"), F.col("date").alias("_of")))
    weeks = summed(weekly_series(bars, x, market)).select("ticker", F.col("monday").alias("date"), F.lit(0).alias("_ask"), *terms)
    w = Window.partitionBy("ticker").orderBy("date", F.abs("_ask"), "_ask", "_of").rowsBetween(FIRST, NOW)
    stream = weeks.unionByName(asks, allowMissingColumns=True)
    sums = stream.select("ticker", "_ask", "_of", *[(F.col("_ask") * F.coalesce(F.sum(k).over(w), F.lit(0.0))).alias(k) for k in terms]).where("_ask <> 0").select("ticker", F.col("_of").alias("date"), *terms)
    # the cut week's own point
    points = bars.select("ticker", "date", F.col(x).alias("x"), F.col(market).alias("m"), F.lit(0).alias("_ask")).unionByName(key.select("ticker", F.col("_s").alias("date"), F.lit(1).alias("_ask"), F.col("date").alias("_of")), allowMissingColumns=True)
    p = Window.partitionBy("ticker").orderBy("date", "_ask").rowsBetween(FIRST, NOW)
    cut = points.select("ticker", "_ask", "_of", F.last("x", ignorenulls=True).over(p).alias("x"), F.last("m", ignorenulls=True).over(p).alias("m")).where("_ask = 1")
    cut = summed(cut).select("ticker", F.col("_of").alias("date"), *terms)
    got = sums.unionByName(cut).groupBy("ticker", "date").agg(*[F.sum(k).alias(k) for k in terms])
    first = bars.groupBy("ticker").agg(F.min("date").alias("_first"))
    n, less = F.col("n"), F.col("n") - 1
    cov = ratio(F.col("sxm") - F.col("sx") * F.col("sm") / n, less)
    var = ratio(F.col("smm") - F.col("sm") * F.col("sm") / n, less)
    diff = F.col("sx") - F.col("sm")
    idio = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("sdd") - diff * diff / n, less)))
    ok = (n > 1) & (F.col("date") >= F.add_months("_first", 12 * years))
    got = got.join(first, "ticker").select("ticker", "date", F.when(ok, ratio(cov, var)).alias("beta"), F.when(ok, idio).alias("idiovol"))
    return samples.join(got.withColumn("betasq", F.col("beta") * F.col("beta")), ["ticker", "date"], "left")


def fill_days(bars: DataFrame) -> DataFrame:
    """A row for every calendar day from a ticker's first to its last bar: values carried forward, can_trade true on its bars.

    Each bar is repeated up to the next one; no calendar is joined.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    values = [c for c in bars.columns if c not in ("ticker", "date")]
    full = bars.select("ticker", "date", F.col("close").isNotNull().alias("_traded"), *[F.last(c, ignorenulls=True).over(w.rowsBetween(FIRST, NOW)).alias(c) for c in values], F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date")).alias("_to"))
    return full.withColumn("_day", F.explode(F.sequence("date", "_to"))).select("ticker", F.col("_day").alias("date"), *values, (F.col("_traded") & (F.col("_day") == F.col("date"))).alias("can_trade"))


def daily_rates(bills: DataFrame) -> DataFrame:
    """(date, rate): per cent to share, rounded to four digits, every calendar day, carried forward over missing values."""
    one = bills.select(F.lit("rate").alias("ticker"), "date", F.col("percent").alias("close"))
    return fill_days(one).select("date", F.round(F.col("close") / 100, 4).alias("rate"))


def interest(rates: DataFrame) -> DataFrame:
    """Add daily, monthly and three_month interest of a three-month rate."""
    return rates.withColumns({"daily": F.pow(F.col("rate") + 1, F.lit(1 / 91)) - 1, "monthly": F.pow(F.col("rate") + 1, F.lit(1 / 3)) - 1, "three_month": F.col("rate")})


def monthly_forward_returns(daily: DataFrame, value: str, rows: int = 30) -> DataFrame:
    """(ticker, month, monthly_return): return over the next ``rows`` daily rows at the last day of each month, nulls dropped."""
    w = Window.partitionBy("ticker").orderBy("date")
    ahead = daily.withColumn("_r", change(F.lead(value, rows).over(w), F.col(value)))
    out = ahead.groupBy("ticker", F.last_day("date").alias("month")).agg(F.max_by("_r", "date").alias("monthly_return"))
    return out.where("monthly_return is not null")


def cumulative_return(df: DataFrame, value: str = "close", out: str = "cumulative") -> DataFrame:
    """Add the return since a ticker's first row."""
    return df.withColumn(out, change(F.col(value), F.first(value).over(Window.partitionBy("ticker").orderBy("date").rowsBetween(FIRST, NOW))))


def resample(bars: DataFrame, unit: str = "week") -> DataFrame:
    """(ticker, period, open, high, low, close, volume): bars of a week or month, first and last by date."""
    return bars.groupBy("ticker", F.date_trunc(unit, "date").cast("date").alias("period")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
