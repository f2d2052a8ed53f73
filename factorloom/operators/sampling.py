"""Choice of the observations that make the dataset."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _next_month(day: int) -> int:
    """The same day of the next month, or its last day; days count from 1970."""
    day = np.datetime64(day, "D")
    month = day.astype("datetime64[M]") + 1
    last = (month + 1).astype("datetime64[D]") - 1
    return int(min(month.astype("datetime64[D]") + (day - day.astype("datetime64[M]").astype("datetime64[D]")), last).astype(np.int64))


class FilingWalk:
    """Chooses the sampled days of one ticker from its days in order, and holds no more than two of them.

    The first day is sampled; then every month after the last base, the nearer of the two days around a missing target (the
    earlier on ties); and each day with a new filing, which is the next base and takes the place of a sample fewer than ``distance`` days
    old. After a gap the target moves on one month a day. A day is any object; what comes out of ``step`` and ``end`` is sampled for good.
    """

    def __init__(self, distance: int) -> None:
        self.distance = distance
        self.target = self.filing = None
        self.before: tuple[int, Any] | None = None
        self.picked: tuple[int, Any] | None = None
        self.times = 0

    def pick(self, day: tuple[int, Any]) -> list[Any]:
        """The new sample may yet give way to a filing; the one before it no longer can. A day that is chosen twice gives way once."""
        if self.picked and self.picked[0] == day[0]:
            self.times += 1
            return []
        out = [self.picked[1]] if self.picked else []
        self.picked, self.times = day, 1
        return out

    def step(self, date: int, filing: Any, rows: Any) -> list[Any]:
        day, first = (date, rows), self.before is None
        if first or filing != self.filing:
            if self.picked and self.picked[0] > date - self.distance:
                self.times -= 1
                self.picked = self.picked if self.times else None
            out = self.pick(day)
            self.target, self.filing = _next_month(date), filing
            if first:
                self.before = day
            return out
        out = []
        if date >= self.target:
            nearer = day if date == self.target or self.target - self.before[0] > date - self.target else self.before
            out = self.pick(nearer)
            self.target = _next_month(self.target)
        self.before = day
        return out

    def end(self) -> list[Any]:
        return [self.picked[1]] if self.picked else []


def walk_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """The sampled rows of one ticker, from batches in order of date; rows of one date are one day and come together.

    A day is a list of spans of rows in the batch at hand, and rows are copied where it is certain that they are sampled: one copy a
    batch, and one of the days that may still be sampled when it ends, so the batch can go.
    """
    walk = FilingWalk(distance)
    date, filing, spans = None, None, []  # the day at hand, and its rows

    def copied(batch: pa.RecordBatch, day: list[Any]) -> list[pa.RecordBatch]:
        return [batch.take(pa.array(range(*span))) if isinstance(span, tuple) else span for span in day]

    for batch in batches:
        days = batch.column("date").cast(pa.int32()).to_numpy(zero_copy_only=False)
        filings = batch.column("datekey").cast(pa.int32())
        starts = np.flatnonzero(np.diff(days, prepend=days[0] - 1)) if len(days) else np.array([], dtype=np.int64)
        sampled = []
        for a, b, at, known in zip(starts.tolist(), [*starts[1:].tolist(), len(days)], days[starts].tolist(), filings.take(pa.array(starts)).to_pylist()):
            if at == date:
                spans.append((a, b))
                continue
            if date is not None:
                sampled += walk.step(date, filing, spans)
            date, filing, spans = at, known, [(a, b)]
        rows = []
        for span in (s for day in sampled for s in day):
            if isinstance(span, tuple):
                rows.extend(range(*span))
            else:
                yield span
        if rows:
            yield batch.take(pa.array(rows))
        for day in (spans, *[held[1] for held in (walk.before, walk.picked) if held]):
            day[:] = copied(batch, day)
    if date is not None:
        for day in [*walk.step(date, filing, spans), *walk.end()]:
            yield from day


def sample_at_filings(bars: DataFrame, distance: int = 20, arranged: bool = False) -> DataFrame:
    """Rows of ``bars`` (ticker, date, datekey, ...) sampled monthly and rebased at each new filing.

    The walk is sequential in one ticker. A ticker's rows reach it sorted, batch by batch, and it hands sampled rows on as soon as they
    are certain, so memory doesn't grow with the ticker, and one shuffle by ticker is all: none for tables stored by ticker (``arranged``).
    Rows without a date aren't sampled; of a date with several rows the first filing counts.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from walk_batches(batches, distance)

    dated = bars.where("date is not null")
    dealt = dated if arranged else dated.repartition("ticker")
    return dealt.sortWithinPartitions("ticker", "date").groupBy("ticker").applyInArrow(walk, bars.schema)


def on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows whose (ticker, date) is among ``days``, neither null: a ticker's days are one array, some hundred at most, so rows that windows left by ticker stay where they are."""
    known = days.groupBy("ticker").agg(F.collect_set("date").alias("_days"))
    return rows.join(known, "ticker").where(F.array_contains("_days", F.col("date"))).select(*rows.columns)


def marked_days(rows: DataFrame, days: DataFrame, out: str = "sampled") -> DataFrame:
    """``on_days`` that keeps all rows and tells which are among the days."""
    known = days.groupBy("ticker").agg(F.collect_set("date").alias("_days"))
    return rows.join(known, "ticker", "left").withColumn(out, F.coalesce(F.array_contains("_days", F.col("date")), F.lit(False))).drop("_days")


def month_end_samples(bars: DataFrame) -> DataFrame:
    """The last bar of each month."""
    last = Window.partitionBy("ticker", F.last_day("date")).orderBy(F.desc("date"))
    return bars.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def with_month_ends(bars: DataFrame, out: str = "month_end") -> DataFrame:
    """Tell the last bar of each month, in the windows by (ticker, date) that bars already go through: no shuffle of its own."""
    after = F.last_day(F.lead("date").over(Window.partitionBy("ticker").orderBy("date")))
    return bars.withColumn(out, ~after.eqNullSafe(F.last_day("date")))


def random_rows(df: DataFrame, by: list[str], n: int, key: list[str], seed: int = 0, parts: int = 16) -> DataFrame:
    """``n`` rows of each group, the same on every run: those with the least digests of ``seed`` and key.

    The least n of a union are among the least n of its sides. So each group is drawn from in ``parts`` parts first, and from what is left of
    them then: no task holds more of a group than a part, or n rows of each part. Up to 1,000 rows Spark also keeps only
    the least n of each task before it shuffles. Rows that are equal in the key share a digest; which of them stays is open.
    """
    luck: Column = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    drawn = df.withColumn("_luck", luck).withColumn("_part", F.pmod(F.xxhash64("_luck"), F.lit(parts)))
    for keys in ([*by, "_part"], by):
        least = Window.partitionBy(*keys).orderBy("_luck", *key)
        drawn = drawn.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= n).drop("_r")
    return drawn.drop("_luck", "_part")
