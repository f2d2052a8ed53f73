"""Trades as tables: commissions, exits from daily bars, cash flows and daily values of positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.asof import binned_range_join

#: fixed values of the tiered commission schedule
LEAST, PER_SHARE, MOST_SHARE = 0.35, 0.0035, 0.01
CLEARING, TRANSACTION, FINRA, NYSE, TRADING_ACTIVITY = 0.0002, 0.0000207, 0.00056, 0.000175, 0.000119


def commission(shares: Column, price: Column) -> Column:
    """Commission and fees of an order of so many shares; a negative price is an error."""
    dollars = shares * price
    own = F.least(F.greatest(F.lit(LEAST), shares * PER_SHARE), dollars * MOST_SHARE)
    total = own + shares * CLEARING + dollars * TRANSACTION + own * (NYSE + FINRA) + shares * TRADING_ACTIVITY
    return F.when(price < 0, F.raise_error(F.lit("price is negative"))).otherwise(total)


def trade_paths(trades: DataFrame, bars: DataFrame, width: int = 32) -> DataFrame:
    """Each trade with its bars from trade_date to timeout, the dividends so far and the returns of low, high and close.

    Trades: order_id, ticker, direction (1, -1), amount, fill_price, trade_date, timeout, take_profit, stop_loss.
    """
    end = F.coalesce("timeout", F.add_months("trade_date", 1))
    asked = trades.withColumn("_to", end)
    days = bars.select("ticker", F.col("date").alias("day"), "open", "high", "low", "close", F.coalesce("dividends", F.lit(0.0)).alias("dividends"))
    path = binned_range_join(asked, days, ["ticker"], "trade_date", "_to", "day", width).drop("_to")
    w = Window.partitionBy("order_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("paid", F.sum("dividends").over(w))
    ret = lambda c: (F.try_divide(F.col(c) + F.col("paid"), F.col("fill_price")) - 1) * F.col("direction")
    return path.withColumns({f"{c}_return": ret(c) for c in ("low", "high", "close")})


def barrier_prices(trades: DataFrame) -> DataFrame:
    """Add the prices at which the barriers are."""
    return trades.withColumns({"take_profit_price": F.col("fill_price") * (1 + F.col("take_profit")), "stop_loss_price": F.col("fill_price") * (1 + F.col("stop_loss"))})


def trade_exits(trades: DataFrame, bars: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """(order_id, close_date, close_price, close_cause, ret, total_ret, total_dividends, proceeds, pnl) of closed trades.

    On a day that ends no lower than it began the low is checked first, then the high; else the high first. A
    long trade stops out on its low and takes profit on its high, a short one the other way. From the
    timeout on a trade closes at the close. After a day's barriers come bankruptcy (price 0) and delisting (close).
    Barrier prices are fill * (1 + limit * direction) less the dividends so far. Trades still open have no row.
    """
    path = trade_paths(trades, bars)
    worst = F.when(F.col("direction") > 0, F.col("low_return")).otherwise(F.col("high_return"))
    best = F.when(F.col("direction") > 0, F.col("high_return")).otherwise(F.col("low_return"))
    stop, take = worst <= F.col("stop_loss"), best >= F.col("take_profit")
    up_day, long_ = F.col("open") <= F.col("close"), F.col("direction") > 0
    stop_first = up_day == long_
    cause = F.when(F.col("day") >= F.col("timeout"), "timeout").when(stop & (stop_first | ~take), "stop_loss").when(take, "take_profit").when(stop, "stop_loss")
    path = path.withColumn("cause", cause)
    if actions is not None:
        path = path.join(actions.select("ticker", F.col("date").alias("day"), F.col("action")), ["ticker", "day"], "left").withColumn("cause", F.coalesce("cause", "action"))
    at = lambda limit: F.col("fill_price") * (1 + F.col(limit) * F.col("direction")) - F.col("paid")
    price = F.when(F.col("cause") == "stop_loss", at("stop_loss")).when(F.col("cause") == "take_profit", at("take_profit")).when(F.col("cause") == "bankruptcy", F.lit(0.0)).otherwise(F.col("close"))
    ended = path.where("cause is not null").withColumn("price", price)
    first = ended.groupBy("order_id").agg(F.min_by(F.struct("day", "price", "cause", "paid", "direction", "amount", "fill_price"), "day").alias("x")).select("order_id", "x.*")
    shares = F.abs("amount")
    ret = (F.try_divide(F.col("price"), F.col("fill_price")) - 1) * F.col("direction")
    total = (F.try_divide(F.col("price") + F.col("paid"), F.col("fill_price")) - 1) * F.col("direction")
    proceeds = F.when(F.col("direction") > 0, shares * F.col("price")).otherwise(ret * F.col("fill_price") * shares)
    return first.select("order_id", F.col("day").alias("close_date"), F.col("price").alias("close_price"), F.col("cause").alias("close_cause"), ret.alias("ret"), total.alias("total_ret"), (F.col("paid") * shares).alias("total_dividends"), proceeds.alias("proceeds"), (total * F.col("fill_price")).alias("pnl"))


def active_days(trades: DataFrame, exits: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of each trade up to its close, or its timeout where it is open."""
    until = trades.join(exits.select("order_id", "close_date"), "order_id", "left").withColumn("timeout", F.coalesce("close_date", "timeout"))
    return trade_paths(until, bars)


def dividend_flows(active: DataFrame, tax: float = 0.25) -> DataFrame:
    """(date, dividends, short_dividends): income of longs after tax, and what shorts pay, by day."""
    cash = F.col("dividends") * F.abs("amount") * (1 - tax)
    return active.where("dividends <> 0").groupBy(F.col("day").alias("date")).agg(F.sum(F.when(F.col("direction") > 0, cash).otherwise(0.0)).alias("dividends"), F.sum(F.when(F.col("direction") < 0, cash).otherwise(0.0)).alias("short_dividends"))


def daily_values(active: DataFrame, initial_margin: float = 0.5, maintenance_margin: float = 0.3, annual_rate: float = 0.0025) -> DataFrame:
    """(date, market_value, exposure, required_margin, short_interest, positions) of open trades by day."""
    n, short = F.abs("amount"), F.col("direction") < 0
    value = F.when(short, n * (F.col("fill_price") - F.col("close"))).otherwise(F.col("amount") * F.col("close"))
    margin = F.when(short, F.col("close") * n * (1 + F.when(F.col("close") <= F.col("fill_price"), initial_margin).otherwise(maintenance_margin))).otherwise(0.0)
    interest = F.when(short, n * F.col("fill_price") * ((1 + annual_rate) ** (1 / 360) - 1)).otherwise(0.0)
    return active.groupBy(F.col("day").alias("date")).agg(F.sum(value).alias("market_value"), F.sum(n * F.col("close")).alias("exposure"), F.sum(margin).alias("required_margin"), F.sum(interest).alias("short_interest"), F.count("*").alias("positions"))


#: kinds of costs, then of income
LEDGER = ("commission", "slippage", "charged", "margin_interest", "account_interest", "short_dividends", "short_losses", "dividends", "interest", "proceeds")
INCOME = ("dividends", "interest", "proceeds")


def cash_entries(trades: DataFrame, exits: DataFrame, active: DataFrame, slippage: float = 0.0) -> DataFrame:
    """(date, kind, amount) of a book's cash flows: fees and what long trades cost, daily interest and dividends of open trades, and what closed ones bring or lose."""

    def entry(df: DataFrame, date: str, kind: str, amount: Column) -> DataFrame:
        return df.select(F.col(date).alias("date"), F.lit(kind).alias("kind"), amount.cast("double").alias("amount"))

    shares = F.abs("amount")
    days, paid = daily_values(active), dividend_flows(active)
    parts = [
        entry(trades, "trade_date", "commission", commission(shares, F.col("fill_price"))), entry(trades, "trade_date", "slippage", shares * slippage),
        entry(trades, "trade_date", "charged", F.when(F.col("direction") > 0, shares * F.col("fill_price")).otherwise(0.0)), entry(days, "date", "margin_interest", F.col("short_interest")),
        entry(paid, "date", "dividends", F.col("dividends")), entry(paid, "date", "short_dividends", F.col("short_dividends")),
        entry(exits.where("proceeds > 0"), "close_date", "proceeds", F.col("proceeds")), entry(exits.where("proceeds < 0"), "close_date", "short_losses", -F.col("proceeds")),
    ]
    return reduce(DataFrame.unionByName, parts)


def daily_balances(entries: DataFrame, start: float) -> DataFrame:
    """(date, balance) after each day with entries: one row a day, added up in date order."""
    cash = F.when(F.col("kind").isin(*INCOME), F.col("amount")).otherwise(-F.col("amount"))
    days = entries.groupBy("date").agg(F.sum(cash).alias("cash"))
    return days.select("date", (start + F.sum("cash").over(Window.orderBy("date"))).alias("balance"))


def account_interest(balances: DataFrame, interest: DataFrame) -> DataFrame:
    """(date, interest): income on a positive day balance, cost on a negative one, of (date, balance, margin_account)."""
    return balances.join(interest.select("date", "daily"), "date").select("date", ((F.col("balance") + F.col("margin_account")) * F.col("daily")).alias("interest"))


def interest_entries(interest: DataFrame) -> DataFrame:
    """Entries of account interest: a cost where it is negative, income where it is positive."""
    kind = F.when(F.col("interest") < 0, "account_interest").otherwise("interest")
    return interest.where("interest <> 0").select("date", kind.alias("kind"), F.abs("interest").alias("amount"))


def ledger(entries: DataFrame, kinds: list[str]) -> DataFrame:
    """One row a day with a column for each kind of (date, kind, amount), and a row with a null date for the total."""
    cells = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("amount"))), F.lit(0.0)).alias(k) for k in kinds]
    return entries.rollup("date").agg(*cells)


def trade_history(trades: DataFrame, exits: DataFrame, orders: DataFrame, signals: DataFrame) -> DataFrame:
    """Every trade with its exit (null while it is open), the date of its order, and the certainty and features date of its signal."""
    why = orders.select("order_id", "signal_id", F.col("date").alias("order_date")).join(signals.select("signal_id", F.col("rebalance").alias("order_date"), "certainty", "features_date"), ["signal_id", "order_date"])
    return trades.drop("signal_id").join(why, "order_id").join(exits, "order_id", "left")


def trade_statistics(closed: DataFrame) -> DataFrame:
    """One row of statistics over closed trades: trades joined with their exits and commission.

    Trades a month are averaged over all months from the first to the last, empty ones too.
    """
    hit = F.col("total_ret") > 0
    shares, dollars = F.abs("amount"), F.abs("amount") * F.col("fill_price")
    months = F.months_between(F.trunc(F.max("trade_date"), "month"), F.trunc(F.min("trade_date"), "month")) + 1
    by_cause = [F.count_if(F.col("close_cause") == c).alias(f"closed_by_{c}") for c in ("stop_loss", "take_profit", "timeout", "bankruptcy", "delisted")]
    return closed.agg(
        F.count("*").alias("trades"), F.count_distinct("ticker").alias("tickers"), F.avg(hit.cast("double")).alias("hit_ratio"), F.avg((F.col("direction") > 0).cast("double")).alias("long_ratio"),
        F.avg(F.when(hit, F.col("total_ret"))).alias("mean_hit"), F.avg(F.when(~hit, F.col("total_ret"))).alias("mean_miss"), F.max("total_ret").alias("max_hit"), F.min("total_ret").alias("min_miss"),
        F.sum(F.when(F.col("direction") > 0, F.col("pnl") * shares)).alias("pnl_long"), F.sum(F.when(F.col("direction") < 0, F.col("pnl") * shares)).alias("pnl_short"),
        F.try_divide(F.count("*"), months).alias("trades_a_month"), F.avg(F.datediff("close_date", "trade_date")).alias("holding_days"),
        F.try_divide(F.sum("commission"), F.sum(dollars)).alias("fees_a_dollar"), F.try_divide(F.sum("commission"), F.sum(shares)).alias("fees_a_share"), F.max(dollars).alias("max_position"), *by_cause,
    )
