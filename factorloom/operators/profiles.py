"""Descriptions of tables from parts that merge: moments with quantile sketches, and distinct counts from sketches.

A part is one row for a column and a slice (a year, a month and industry, ...). Parts can be stored; any set of them gives the description
of the rows that they were made of, so a new slice costs one pass over its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.expressions import ratio

#: size of the quantile sketches (larger: closer), and rank of the quantiles that are reported
K, RANKS = 2048, {"q25": 0.25, "median": 0.5, "q75": 0.75}
#: binary logarithm of the buckets of a distinct sketch
LOG_BUCKETS = 12


def rank_bound(k: int = K) -> float:
    """How far a sketched quantile's rank is from the one asked for: three times what one sketch in a hundred exceeds."""
    return 3 * 2.296 / k**0.9723


def finite(c: str) -> Column:
    """The column as a double, null where it isn't finite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def profile_parts(df: DataFrame, columns: list[str], by: list[str] | None = None, k: int = K) -> DataFrame:
    """(by, column, rows, n, mean, m2, low, high, sketch): one row a slice and column, from one pass over the table.

    All columns are aggregated side by side, before and after the shuffle, so a task sends one row a slice; values that aren't finite count as nulls.
    m2 is the sum of squared distances from the mean.
    """
    by = by or []
    cells = []
    for i, c in enumerate(columns):
        x = finite(c)
        cells += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), (F.var_pop(x) * F.count(x)).alias(f"v{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), F.kll_sketch_agg_double(x, k).alias(f"s{i}")]
    wide = (df.groupBy(*by) if by else df).agg(F.count("*").alias("_rows"), *cells)
    names = ("n", "mean", "m2", "low", "high", "sketch")
    tall = [F.struct(F.lit(c).alias("column"), *[F.col(f"{a}{i}").alias(x) for a, x in zip("navlhs", names)]) for i, c in enumerate(columns)]
    return wide.select(*by, F.col("_rows").alias("rows"), F.explode(F.array(*tall)).alias("c")).select(*by, "c.column", "rows", *[f"c.{x}" for x in names])


def merge_parts(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parts of the slices ``by`` (none: of the whole) from parts of finer ones."""
    keys = [*(by or []), "column"]
    shifted = F.sum(F.col("m2")) + F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_at"), 2))
    centre = parts.groupBy(*keys).agg(ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_at"))
    joined = parts.join(centre.withColumnsRenamed({c: f"_{c}" for c in keys}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return joined.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.first("_at").alias("mean"), shifted.alias("m2"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def described(parts: DataFrame, ranks: dict[str, float] = RANKS) -> DataFrame:
    """Parts as a report: rows, n, nulls, mean, std (sample), low, the sketched quantiles of ``ranks``, high. Columns without a value have nulls."""
    keys = [c for c in parts.columns if c not in ("rows", "n", "mean", "m2", "low", "high", "sketch")]
    quantiles = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(name) for name, p in ranks.items()]
    return parts.select(*keys, "rows", "n", (F.col("rows") - F.col("n")).alias("nulls"), "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"), "low", *quantiles, "high")


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None, k: int = K) -> DataFrame:
    """Description of the columns, whole or by slice: one pass, then a report of as many rows as there are columns and slices."""
    return described(profile_parts(df, columns, by, k))


def true_ranks(df: DataFrame, report: DataFrame, ranks: dict[str, float] = RANKS) -> DataFrame:
    """(column, quantile, below, upto): the shares of a column's values under, and not over, each reported quantile; one pass.

    ``report`` is a description of the whole table: a row a column.
    """
    rows = {r["column"]: r for r in report.where("n > 0").collect()}
    cells, tall = [], []
    for i, (c, r) in enumerate(rows.items()):
        x = finite(c)
        for j, q in enumerate(ranks):
            cells += [(F.count_if(x < r[q]) / F.count(x)).alias(f"b{i}_{j}"), (F.count_if(x <= r[q]) / F.count(x)).alias(f"u{i}_{j}")]
            tall.append(F.struct(F.lit(c).alias("column"), F.lit(q).alias("quantile"), F.col(f"b{i}_{j}").alias("below"), F.col(f"u{i}_{j}").alias("upto")))
    if not tall:
        return df.sparkSession.createDataFrame([], "column string, quantile string, below double, upto double")
    return df.agg(*cells).select(F.explode(F.array(*tall)).alias("c")).select("c.*")


def distinct_parts(df: DataFrame, value: str, by: list[str], log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """(by, sketch): a HyperLogLog sketch of the values of each slice; nulls don't count. What is no number or text counts by its text."""
    x = F.col(value) if df.schema[value].dataType.typeName() in ("integer", "long", "string", "binary") else F.col(value).cast("string")
    return df.groupBy(*by).agg(F.hll_sketch_agg(x, F.lit(log_buckets)).alias("sketch"))


def distinct_counts(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n): distinct values in unions of slices. Slices may overlap in values; a value counts once."""
    grouped = parts.groupBy(*by) if by else parts
    return grouped.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))), F.lit(0).cast("long")).alias("n"))


def distinct_over(parts: DataFrame, spans: DataFrame, time: str, by: list[str]) -> DataFrame:
    """(span, by, n): distinct values of every span (span, first, last; both ends included) from the slices that begin in it.

    Spans may overlap: one row of parts, not of the table, is repeated for each span it falls in.
    """
    within = parts.join(F.broadcast(spans), F.col(time).between(F.col("first"), F.col("last")))  # a few rows of parameters
    return distinct_counts(within, ["span", *by])


def exact_over(df: DataFrame, value: str, spans: DataFrame, time: str, by: list[str]) -> DataFrame:
    """(span, by, n): what ``distinct_over`` estimates, without error. Repeats in a slice go before rows are repeated for their spans; the value is part of every key."""
    slices = df.where(F.col(value).isNotNull()).select(*dict.fromkeys([time, *by, value])).distinct()
    within = slices.join(F.broadcast(spans), F.col(time).between(F.col("first"), F.col("last")))  # a few rows of parameters
    return within.select("span", *by, value).distinct().groupBy("span", *by).agg(F.count("*").alias("n"))


def distinct_bound(log_buckets: int = LOG_BUCKETS) -> float:
    """Relative error that an estimate from a full sketch exceeds about once in 15,000: four standard errors."""
    return 4 * 1.04 / 2 ** (log_buckets / 2)
