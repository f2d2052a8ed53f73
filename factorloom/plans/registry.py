"""Where queries and their DuckDB counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.expressions import rounded
from factorloom.plans.oracles import r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under its function's name, doubles rounded."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def cols(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits) for n in names)


#: keeps ties of short decimals on one side in both engines
NUDGE = 1.0000000003


def significant(c: Column, digits: int) -> Column:
    """A double to so many significant digits, for comparison only; what is under 1e-8 is 0."""
    return F.when(F.abs(c) < 1e-8, 0.0).when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c * NUDGE).cast("double"))


def significant_sql(x: str, digits: int, name: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-8 THEN 0.0 ELSE CAST(printf('%.{digits - 1}e', ({x}) * {NUDGE}) AS DOUBLE) END AS {name}"
