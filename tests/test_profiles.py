"""Descriptions and distinct counts from merged parts, against numpy and sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import profiles


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(5)
    rows = [(rng.randint(2000, 2004), rng.gauss(1e6, 3), rng.choice([None, float("nan"), float("inf"), 1.0, -2.5]), None, rng.randint(-5, 5)) for _ in range(20_000)]
    rows += [(None, 1e6, 7.0, None, 3), (1999, None, None, None, None)]
    return spark.createDataFrame(rows, "year int, a double, b double, empty double, whole int").repartition(5), rows


def plain(values, rows):
    x = np.array([v for v in values if v is not None and math.isfinite(v)], float)
    return rows, len(x), rows - len(x), *((x.mean() if len(x) else None, x.std(ddof=1) if len(x) > 1 else None, x.min() if len(x) else None, x.max() if len(x) else None)), np.sort(x)


def same(r, want):
    assert (r["rows"], r.n, r.nulls) == want[:3]
    for mine, theirs in zip((r["mean"], r["std"], r.low, r.high), want[3:7]):
        assert mine == theirs if theirs is None else mine == pytest.approx(theirs, rel=1e-9)
    x = want[7]
    for name, p in profiles.RANKS.items():
        if not len(x):
            assert r[name] is None
        else:
            assert np.searchsorted(x, r[name], "left") / len(x) - profiles.rank_bound() <= p <= np.searchsorted(x, r[name], "right") / len(x) + profiles.rank_bound()


COLUMNS = ["a", "b", "empty", "whole"]


def test_description_of_the_whole(table):
    df, rows = table
    got = {r["column"]: r for r in profiles.describe(df, COLUMNS).collect()}
    for i, c in enumerate(COLUMNS, 1):
        same(got[c], plain([r[i] for r in rows], len(rows)))


def test_parts_merge_to_any_span(spark, table, tmp_path):
    df, rows = table
    profiles.profile_parts(df, COLUMNS, ["year"]).write.parquet(f"{tmp_path}/parts")  # parts are kept, the table isn't read again
    parts = spark.read.parquet(f"{tmp_path}/parts")
    spans = {"all": lambda y: True, "late": lambda y: y is not None and y >= 2002, "none": lambda y: y is None}
    for name, where in spans.items():
        chosen = parts if name == "all" else parts.where("year >= 2002" if name == "late" else "year is null")
        got = {r["column"]: r for r in profiles.described(profiles.merge_parts(chosen)).collect()}
        inside = [r for r in rows if where(r[0])]
        for i, c in enumerate(COLUMNS, 1):
            same(got[c], plain([r[i] for r in inside], len(inside)))
    by_half = profiles.merge_parts(parts.withColumn("half", F.col("year") > 2001), ["half"])
    assert {(r.half, r["column"], r["rows"]) for r in by_half.collect()} == {(h, c, sum((None if r[0] is None else r[0] > 2001) == h for r in rows)) for h in (True, False, None) for c in COLUMNS}


def test_one_pass_and_few_rows_through_the_shuffle(table):
    plan = profiles.profile_parts(table[0], COLUMNS, ["year"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("kll_sketch_agg_double") < plan.rindex("partial_") and "Window" not in plan


def test_ranks_of_a_report(table):
    df, _ = table
    report = profiles.describe(df, COLUMNS)
    ranks = {(r["column"], r.quantile): r for r in profiles.true_ranks(df, report).collect()}
    assert {c for c, _ in ranks} == {"a", "b", "whole"}
    assert all(r.below - profiles.rank_bound() <= profiles.RANKS[q] <= r.upto + profiles.rank_bound() for (_, q), r in ranks.items())
    off = report.withColumns({q: F.col(q) + 4 for q in profiles.RANKS})
    assert any(r.below > profiles.RANKS[r.quantile] + profiles.rank_bound() for r in profiles.true_ranks(df, off).collect())


def test_no_rows(spark):
    none = spark.createDataFrame([], "year int, a double")
    (r,) = profiles.describe(none, ["a"]).collect()
    assert (r["rows"], r.n, r["mean"], r["median"]) == (0, 0, None, None)
    assert profiles.profile_parts(none, ["a"], ["year"]).count() == 0 and profiles.true_ranks(none, profiles.describe(none, ["a"])).count() == 0
    assert profiles.distinct_counts(profiles.distinct_parts(none, "a", ["year"])).first().n == 0


def test_distinct_counts_unite(spark):
    rng = random.Random(6)
    rows = [(m, rng.randint(0, 30_000) if m % 3 else None) for m in range(12) for _ in range(4000)]
    df = spark.createDataFrame(rows, "month int, who int").repartition(7)
    parts = profiles.distinct_parts(df.withColumn("who", F.col("who").cast("string")), "who", ["month"])
    spans = spark.createDataFrame([("a", 1, 2), ("b", 0, 11), ("c", 3, 3), ("d", 40, 50)], "span string, first int, last int")
    got = {r.span: r.n for r in profiles.distinct_over(parts, spans, "month", []).collect()}
    assert got.pop("c") == 0 and set(got) == {"a", "b"}
    for name, lo, hi in (("a", 1, 2), ("b", 0, 11)):
        exact = len({w for m, w in rows if lo <= m <= hi and w is not None})
        assert abs(got[name] - exact) <= profiles.distinct_bound() * exact
    again = profiles.distinct_counts(profiles.distinct_parts(df.withColumn("who", F.col("who").cast("string")).union(df.select("month", F.col("who").cast("string"))), "who", ["month"])).first().n
    assert again == got["b"]  # repeated rows, another dealing: the same sketch


def test_few_values_are_counted_exactly(spark):
    df = spark.range(3000).select((F.col("id") % 5).alias("g"), (F.col("id") % 40).cast("string").alias("v"))
    assert {(r.g, r.n) for r in profiles.distinct_counts(profiles.distinct_parts(df, "v", ["g"]), ["g"]).collect()} == {(g, 8) for g in range(5)}
