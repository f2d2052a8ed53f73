"""As-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.expressions import quarter_index


def attach_filings(bars: DataFrame, filings: DataFrame, carry: tuple[str, ...] = ("sharesbas", "sharefactor")) -> DataFrame:
    """Each bar with the filing known on its date: among those with datekey <= date the latest period, then its latest datekey.

    Filings and bars are one stream by ticker and date, and the running maximum of the struct (calendardate,
    datekey, carried values) is the answer: one shuffle, no range join. Bars before the first filing go.
    """
    fields = ["calendardate", "datekey", *carry]
    known = filings.where("datekey is not null and calendardate is not null").select("ticker", F.col("datekey").alias("date"), F.lit(0).alias("_bar"), F.struct(*fields).alias("_known"))
    w = Window.partitionBy("ticker").orderBy("date", "_bar").rowsBetween(Window.unboundedPreceding, 0)
    both = bars.withColumn("_bar", F.lit(1)).unionByName(known, allowMissingColumns=True).withColumn("_at", F.max("_known").over(w))
    return both.where("_bar = 1 and _at is not null").select(*bars.columns, "_at.*", F.datediff("date", "_at.datekey").alias("age"))


def attach_filings_listed(bars: DataFrame, filings: DataFrame, carry: tuple[str, ...] = ("sharesbas", "sharefactor")) -> DataFrame:
    """``attach_filings`` for tables stored together by ticker: the same rows by an equi-join, which leaves both where they are.

    A union of two stored tables would be shuffled; here each ticker's filings (some hundred at most) become one array, and a
    bar takes the greatest known entry of its ticker's.
    """
    fields = ["calendardate", "datekey", *carry]
    known = filings.where("datekey is not null and calendardate is not null").groupBy("ticker").agg(F.collect_list(F.struct(*fields)).alias("_all"))
    at = F.array_max(F.filter("_all", lambda x: x["datekey"] <= F.col("date")))
    joined = bars.join(known, "ticker").withColumn("_at", at).where("_at is not null")
    return joined.select(*bars.columns, "_at.*", F.datediff("date", "_at.datekey").alias("age"))


def enrich(df: DataFrame, metadata: DataFrame, columns: tuple[str, ...] = ("industry", "sector", "siccode")) -> DataFrame:
    """Rows of tickers that have metadata, with its columns, all from the last row (``last_rows``); Spark broadcasts them where they are small."""
    return df.join(last_rows(metadata, columns), "ticker")


def last_rows(metadata: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(ticker, columns...) of one row a ticker: that with the latest first price, then the greatest values, nulls least."""
    order = [c for c in ("firstpricedate", *columns) if c in metadata.columns]
    return metadata.groupBy("ticker").agg(F.max(F.struct(*dict.fromkeys(order))).alias("_m")).select("ticker", *[F.col(f"_m.{c}").alias(c) for c in columns])


def filing_lags(current: DataFrame, looks: list[tuple[DataFrame | None, list[int], list[str], str]]) -> DataFrame:
    """``current`` with, for each look-up (history, lags, values, prefix), prefix{lag}_{value} of the filing ``lag`` quarters earlier that was public by then.

    Of several filings of a quarter the latest that was public counts. A history of None is ``current`` itself. The filings of a quarter,
    one and its few amendments, are one row; the row of ``lag`` quarters before is found in a window over a ticker's
    quarters, so everything is shuffled once, by ticker, and nothing is repeated for each lag. has_{prefix}{lag} tells whether
    there is such a filing; a single lag isn't part of the names.
    """
    quarter = quarter_index(F.col("calendardate")).alias("_q")
    base = current.select("ticker", quarter, F.struct("datekey", *[c for c in current.columns if c != "datekey"]).alias("_own"))
    for n, (history, _, values, _) in enumerate(looks):
        if history is not None:
            base = base.unionByName(history.select("ticker", quarter, F.struct("datekey", *values).alias(f"_h{n}")), allowMissingColumns=True)
    base = base if len(base.columns) == 3 else base.repartition("ticker")
    quarters = base.groupBy("ticker", "_q").agg(*[F.collect_list(c).alias(c) for c in base.columns[2:]])
    back = lambda i: Window.partitionBy("ticker").orderBy("_q").rangeBetween(-i, -i)
    lists = {f"_{prefix}{i}": F.first("_own" if history is None else f"_h{n}").over(back(i)) for n, (history, lags, _, prefix) in enumerate(looks) for i in lags}
    rows = quarters.withColumns(lists).select(*lists, F.explode("_own").alias("_c"))
    known = lambda c: F.array_max(F.filter(c, lambda x: x["datekey"] <= F.col("_c.datekey"))).alias(c)
    rows = rows.select("_c", *map(known, lists))
    out = [F.col(f"_c.{c}").alias(c) for c in current.columns]
    for _, lags, values, prefix in looks:
        for i in lags:
            name = f"{prefix}{i if len(lags) > 1 else ''}"
            out += [F.col(f"_{prefix}{i}").isNotNull().alias(f"has_{name}"), *[F.col(f"_{prefix}{i}.{v}").alias(f"{name}_{v}") for v in values]]
    return rows.select(*out)


def binned_range_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, at: str, days: int, how: str = "inner") -> DataFrame:
    """Rows of ``right`` whose date ``at`` lies in [start, end] of a left row with equal keys.

    Both sides are cut into bins of ``days`` days; a left row goes to the bins that its interval meets, so the join is
    an equi-join on (keys, bin) and only dates of neighbouring bins are ever compared.
    """
    bin_ = lambda c: F.floor(F.unix_date(F.col(c)) / days)
    cut = left.withColumn("_bin", F.explode(F.sequence(bin_(start), bin_(end))))
    renamed = right.withColumn("_bin", bin_(at))
    return cut.join(renamed, [*keys, "_bin"], how).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def nearest_within(left: DataFrame, right: DataFrame, left_date: str, right_date: str, margin: int) -> DataFrame:
    """Each left row with the right row of its ticker whose date is closest, at most ``margin`` days off; earlier on ties; else dropped."""
    asked = left.withColumn("_from", F.date_sub(left_date, margin)).withColumn("_to", F.date_add(left_date, margin)).withColumn("_l", F.struct(*left.columns))
    value = F.struct(*[c for c in right.columns if c != "ticker"])
    met = binned_range_join(asked.select("ticker", "_from", "_to", "_l"), right.select("ticker", F.col(right_date).alias("_at"), value.alias("_r")), ["ticker"], "_from", "_to", "_at", max(1, 2 * margin))
    off = F.abs(F.datediff(F.col("_at"), F.col(f"_l.{left_date}")))
    best = met.groupBy("ticker", "_l").agg(F.min_by("_r", F.struct(off, F.col("_at"))).alias("_r"))
    return best.select("_l.*", "_r.*")


def trailing_window(dates: DataFrame, features: DataFrame, age: int) -> DataFrame:
    """(rebalance, features...): for each date the features of the ``age`` days before it."""
    spread = features.withColumn("rebalance", F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", age))))
    return spread.join(dates.select(F.col("date").alias("rebalance")).distinct(), "rebalance")


def fill_quarters(filings: DataFrame, limit: int = 3) -> DataFrame:
    """Filings with missing quarters filled by copies of the row before, ``limit`` at most; copies keep its datekey and are marked is_filled.

    The last filing is not continued. Nulls in a row stay null.
    """
    w = Window.partitionBy("ticker").orderBy("calendardate", "datekey")
    q = quarter_index(F.col("calendardate"))
    gaps = filings.withColumn("_gap", F.coalesce(F.lead(q).over(w) - q, F.lit(1)))
    spread = gaps.withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(limit), F.col("_gap") - 1)))))
    filled = spread.withColumn("is_filled", F.col("_k") > 0).drop("_gap")
    end: Column = F.last_day(F.add_months("calendardate", F.col("_k") * 3))
    return filled.withColumn("calendardate", F.when(F.col("_k") > 0, end).otherwise(F.col("calendardate"))).drop("_k")
