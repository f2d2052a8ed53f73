"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(now: Column, then: Column) -> Column:
    """now / then - 1."""
    return ratio(now, then) - 1


def no_nan(df: DataFrame) -> DataFrame:
    """Infinite and NaN doubles become null: nulls are the only missing values here."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def quarter_index(date: Column) -> Column:
    """Quarters since year zero: neighbours differ by one."""
    return F.year(date) * 4 + F.quarter(date) - 1


def quarter_end(index: Column) -> Column:
    """The last day of the quarter with this index."""
    return F.last_day(F.make_date(F.floor(index / 4).cast("int"), (F.pmod(index, F.lit(4)) * 3 + 3).cast("int"), F.lit(1)))


def quarter_ends(first: Column, last: Column) -> Column:
    """The quarter ends from one date's quarter to another's; none where the last is earlier."""
    span = F.sequence(quarter_index(first), F.greatest(quarter_index(first), quarter_index(last)))
    return F.when(quarter_index(last) < quarter_index(first), F.array().cast("array<date>")).otherwise(F.transform(span, quarter_end))


def is_quarter_end(date: Column) -> Column:
    return date == quarter_end(quarter_index(date))


def shift_quarters(date: Column, quarters: int) -> Column:
    """The quarter end so many quarters on; an error for dates that end no quarter."""
    return F.when(is_quarter_end(date), quarter_end(quarter_index(date) + quarters)).otherwise(F.raise_error(F.concat(F.lit("not a quarter end: "), date.cast("string"))))


def rounded_double(c: Column, digits: int) -> Column:
    """A double rounded as the other engine does it: times a power of ten it goes to the nearest whole number, halves away from zero, and is divided again.

    Spark's own rounding takes the shortest decimal that stands for the double, which ends in a half where the product doesn't. No zero is negative; what isn't finite stays.
    Beyond 1e15 the product itself ends in halves that the double doesn't have, and Spark's rounding is taken.
    """
    power = float(10**digits)
    return F.when(F.abs(c) < 1e15 / power, F.round(c * power, 0) / power).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison with results that add up in another order; to more than nine digits they are those of short decimals already, and stay."""
    round_ = rounded_double if digits <= 9 else F.round
    return df.select(*[round_(F.col(c), digits).alias(c) if isinstance(df.schema[c].dataType, DoubleType) else F.col(c) for c in df.columns])
