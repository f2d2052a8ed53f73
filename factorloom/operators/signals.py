"""Signals and orders per rebalance date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.stages import with_ordinal
from factorloom.operators.asof import trailing_window


def rebalance_dates(business: DataFrame, weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Business days on the allowed weekdays (0: Monday)."""
    return business.where("is_business_day").where(F.weekday("date").isin(*weekdays)).select("date")


def make_signals(dates: DataFrame, scored: DataFrame, tradeable: DataFrame, age: int = 5, longs: int = 15, shorts: int = 6) -> DataFrame:
    """(rebalance, signal_id, ticker, direction, certainty, ewmstd, features_date) of the surest longs and shorts of each date.

    ``scored`` has ticker, date, side, certainty and ewmstd; signal_id is its running number in date order, then by ticker. Candidates are the features of the ``age`` days before a date;
    the best of each side are ranked in a window whose partial ranks run before the shuffle; only then are
    tickers dropped that can't be traded on the date.
    """
    seen = trailing_window(dates, with_ordinal(scored, ["date", "ticker"], "signal_id"), age)
    best = Window.partitionBy("rebalance", "side").orderBy(F.desc("certainty"), "signal_id")
    ranked = seen.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= F.when(F.col("side") > 0, longs).otherwise(shorts))
    open_ = tradeable.where("is_tradeable").select("ticker", F.col("date").alias("rebalance"))
    return ranked.join(open_, ["ticker", "rebalance"], "left_semi").select("rebalance", "signal_id", "ticker", F.col("side").alias("direction"), "certainty", "ewmstd", F.col("date").alias("features_date"))


def top_signals(signals: DataFrame, used: DataFrame, held: DataFrame, orders: int = 5, shorts: int = 2) -> DataFrame:
    """The surest signals of each date: up to ``shorts`` shorts, one a ticker, then any side up to ``orders`` in all.

    Signals already used (signal_id) and tickers held on the date (rebalance, ticker) are left out.
    """
    fresh = signals.join(used.select("signal_id"), "signal_id", "left_anti").join(held.select("rebalance", "ticker"), ["rebalance", "ticker"], "left_anti")
    sure = [F.desc("certainty"), F.asc("signal_id")]
    one = fresh.withColumn("_t", F.row_number().over(Window.partitionBy("rebalance", "ticker", "direction").orderBy(*sure)))
    first = Window.partitionBy("rebalance", F.expr("direction < 0 and _t = 1")).orderBy(*sure)
    marked = one.withColumn("_short", F.expr("direction < 0 and _t = 1") & (F.row_number().over(first) <= shorts))
    taken = marked.withColumn("_busy", F.max(F.when(F.col("_short"), F.lit(1)).otherwise(0)).over(Window.partitionBy("rebalance", "ticker")))
    pool = taken.where("_short or _busy = 0")
    order = Window.partitionBy("rebalance").orderBy(F.desc("_short"), *sure)
    return pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= orders).select(*signals.columns)


def allocations(signals: DataFrame) -> DataFrame:
    """Add allocation: (certainty - 0.5) over its sum on the date; a certainty of 0.5 or less is an error."""
    surplus = F.when(F.col("certainty") > 0.5, F.col("certainty") - 0.5).otherwise(F.raise_error(F.lit("certainty must exceed 0.5")))
    return signals.withColumn("_s", surplus).withColumn("allocation", F.col("_s") / F.sum("_s").over(Window.partitionBy("rebalance"))).drop("_s")


def judged_orders(signals: DataFrame, bars: DataFrame, funds: DataFrame, max_position: float = 0.05, volume_limit: float = 0.1, initial_margin: float = 0.5, least: float = 100.0, barriers: tuple[float, float] = (1.0, -1.0)) -> DataFrame:
    """Orders of allocated signals, given (date, value, funds) for each date, with ``error`` (null for orders that stand).

    Dollars are the lesser of a share of the portfolio and the allocated funds, shorts less by the initial margin; shares are
    bounded by yesterday's volume. Orders under ``least`` dollars are an error. Barriers are deviations, the timeout a month.
    """
    day = bars.select("ticker", F.col("date").alias("rebalance"), "open", F.lag("volume").over(Window.partitionBy("ticker").orderBy("date")).alias("_volume"))
    out = signals.join(day, ["ticker", "rebalance"]).join(funds.withColumnRenamed("date", "rebalance"), "rebalance")
    dollars = F.least(F.col("value") * max_position, F.col("funds") * F.col("allocation"))
    dollars = F.when(F.col("direction") < 0, dollars / (1 + initial_margin)).otherwise(dollars)
    shares = F.least(F.floor(F.col("_volume") * volume_limit), F.floor(F.try_divide(dollars, F.col("open"))))
    out = out.withColumn("shares", shares)
    stands = F.coalesce(F.col("shares") * F.col("open") >= least, F.lit(False))
    return out.select(
        F.col("signal_id").alias("order_id"), "signal_id", F.col("rebalance").alias("date"), "ticker", (F.col("shares") * F.col("direction")).alias("amount"), "direction",
        (F.col("ewmstd") * barriers[0]).alias("take_profit"), (F.col("ewmstd") * barriers[1]).alias("stop_loss"), F.add_months("rebalance", 1).alias("timeout"), F.col("open").alias("fill_price"),
        F.when(~stands, F.lit("below the least order")).alias("error"),
    )


def size_orders(signals: DataFrame, bars: DataFrame, funds: DataFrame, **how) -> DataFrame:
    """The orders of ``judged_orders`` that stand."""
    return judged_orders(signals, bars, funds, **how).where("error is null").drop("error")


def cancelled_orders(signals: DataFrame, bars: DataFrame, funds: DataFrame, **how) -> DataFrame:
    """The others, with their error."""
    return judged_orders(signals, bars, funds, **how).where("error is not null")
