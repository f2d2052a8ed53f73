"""Streaming forms: a feature feed, bars of weeks, sliding return statistics and a monitor that closes trades."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def feature_feed(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 8, files: str = "*.parquet") -> DataFrame:
    """Features as they arrive in a folder, in files of this name pattern; the query's checkpoint remembers what it has emitted."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", files).parquet(path)


def tumbling_bars(ticks: DataFrame, length: str = "7 days", late: str = "2 days") -> DataFrame:
    """(ticker, start, open, high, low, close, volume) of ticks (ticker, ts, price, volume) in windows; later ticks than ``late`` are dropped."""
    at = F.struct("ts", "price")
    bars = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", length).alias("w")).agg(F.min(at).alias("a"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at).alias("b"), F.sum("volume").alias("volume"))
    return bars.select("ticker", F.col("w.start").alias("start"), F.col("a.price").alias("open"), "high", "low", F.col("b.price").alias("close"), "volume")


def sliding_statistics(returns: DataFrame, length: str = "30 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """(ticker, end, maxret, retvol, n) of (ticker, ts, ret) in sliding windows."""
    out = returns.withWatermark("ts", late).groupBy("ticker", F.window("ts", length, step).alias("w")).agg(F.max("ret").alias("maxret"), F.stddev_samp("ret").alias("retvol"), F.count("*").alias("n"))
    return out.select("ticker", F.col("w.end").alias("end"), "maxret", "retvol", "n")


MONITOR = "order_id long, ticker string, close_ts timestamp, close_price double, close_cause string, ret double"
#: the state store that keyed state with timers needs
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def exit_monitor() -> StatefulProcessor:
    """The keyed state of ``monitor_exits``. The class is made here so that it travels to the workers by value."""

    class ExitMonitor(StatefulProcessor):
        """One ticker: its open trades by order, the last price seen (times in microseconds), and one timer for each trade's timeout."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getMapState("open", "order_id long", "ts long, direction int, fill double, take double, stop double, until long")
            self.last = handle.getValueState("last", "ts long, price double")

        def closed(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
            if rows:
                yield pd.DataFrame(rows, columns=["order_id", "ticker", "close_ts", "close_price", "close_cause", "ret"])

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            events = pd.concat(list(rows)).sort_values(["ts", "kind", "order_id"])
            events = events[events["ts"] >= pd.Timestamp(max(0, timerValues.getCurrentWatermarkInMs()), unit="ms")]
            held = {k[0]: v for k, v in self.open.iterator()}
            before, out, last = set(held), [], None
            moments, until = (events[c].to_numpy().astype("datetime64[us]").astype("int64").tolist() for c in ("ts", "timeout"))
            for at, end, ts, kind, price, order, direction, take, stop in zip(moments, until, *(events[c].tolist() for c in ("ts", "kind", "price", "order_id", "direction", "take_profit", "stop_loss"))):
                if kind == "order":
                    held[int(order)] = (at, int(direction), price, take, stop, end)
                    continue
                last = (at, price)
                for k, (opened, side, fill, up, down, expiry) in list(held.items()):
                    if at < opened:
                        continue
                    ret = (price / fill - 1) * side
                    cause = "timeout" if at >= expiry else "stop_loss" if ret <= down else "take_profit" if ret >= up else None
                    if cause:
                        out.append((k, key[0], ts, price, cause, ret))
                        del held[k]
            for k in before - set(held):  # their timers find nothing to close
                self.open.removeKey((k,))
            for k in set(held) - before:
                self.open.updateValue((k,), held[k])
                self.handle.registerTimer(-(-held[k][5] // 1000))
            if last is not None:
                self.last.update(last)
            yield from self.closed(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now, last, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, self.last.get(), []
            for (k,), (at, side, fill, _, _, until) in list(self.open.iterator()):
                if until <= now:
                    price = last[1] if last is not None and last[0] >= at else fill
                    out.append((k, key[0], pd.Timestamp(until, unit="us"), price, "timeout", (price / fill - 1) * side))
                    self.open.removeKey((k,))
            yield from self.closed(out)

        def close(self) -> None:
            pass

    return ExitMonitor()


def monitor_exits(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Closed trades of a stream of orders and prices by ticker.

    ``events``: ticker, ts, kind (order or price), price, order_id, direction, take_profit, stop_loss, timeout; rows whose price isn't
    positive are no events. Orders open at their price and stay in the ticker's state until a later price is at or beyond a barrier
    (stop first), is at or after their timeout, or until event time passes their timeout: then they close at the last price
    seen since they opened, their own if there was none. Events of one time run orders first, then by order_id; events later than
    ``late`` are dropped.
    Sets the state store that timers need.
    """
    events.sparkSession.conf.set(*STATE_STORE)
    seen = events.where("price > 0").withWatermark("ts", late)
    return seen.groupBy("ticker").transformWithStateInPandas(exit_monitor(), MONITOR, "append", "EventTime")


def streamed_paths(orders: DataFrame, bars: DataFrame, hold: str = "40 days", late: str = "5 days") -> DataFrame:
    """(orders' columns, bars' columns but ticker): each order with the bars of its ticker from ``opened`` to ``until``, both streams.

    ``orders`` has ticker, opened, until (times); ``bars`` has ticker, ts. No order is held longer than ``hold``: that bound lets the
    join forget an order once the bars' event time is past it, and a bar once the orders' is, so the state has as many rows
    as are open. Orders and bars over ``late`` behind their own stream are dropped. An order without a known end is held for all of ``hold``.
    """
    opened = orders.withWatermark("opened", late).withColumnRenamed("ticker", "_ticker")
    seen = bars.withWatermark("ts", late)
    within = (F.col("_ticker") == F.col("ticker")) & (F.col("ts") >= F.col("opened")) & (F.col("ts") <= F.col("opened") + F.expr(f"INTERVAL {hold}"))
    ends = F.col("until").isNull() | (F.col("ts") <= F.col("until"))
    joined = opened.join(seen, within & ends)
    return joined.select("ticker", *[c for c in orders.columns if c != "ticker"], *[c for c in bars.columns if c != "ticker"])


def streamed_exits(orders: DataFrame, bars: DataFrame, hold: str = "40 days", late: str = "5 days") -> DataFrame:
    """(order_id, opened, closed, price, cause): the first bar of each order whose low or high is at a barrier, or the first at its end.

    On top of ``streamed_paths``, so ``orders`` also has order_id, direction, take_price, stop_price; ``bars`` low, high, close. An order's row comes
    once no bar of it can follow any more. The stop counts before the profit of the same bar.
    """
    up = F.col("direction") > 0
    stop = F.when(up, F.col("low") <= F.col("stop_price")).otherwise(F.col("high") >= F.col("stop_price"))
    take = F.when(up, F.col("high") >= F.col("take_price")).otherwise(F.col("low") <= F.col("take_price"))
    cause = F.when(stop, "stop_loss").when(take, "take_profit").when(F.col("ts") >= F.col("until"), "timeout")
    price = F.when(F.col("cause") == "stop_loss", F.col("stop_price")).when(F.col("cause") == "take_profit", F.col("take_price")).otherwise(F.col("close"))
    touched = streamed_paths(orders, bars, hold, late).withColumn("cause", cause).where("cause is not null").withColumn("price", price)
    first = touched.groupBy("order_id", "opened").agg(F.min(F.struct("ts", "price", "cause")).alias("x"))
    return first.select("order_id", "opened", F.col("x.ts").alias("closed"), "x.price", "x.cause")
