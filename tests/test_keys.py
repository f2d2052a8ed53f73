"""Look-ups that skip row groups, random rows of hot groups, walks of flat memory, callbacks with side tables."""

import datetime as dt
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.operators import callbacks, sampling
from factorloom.sources import keyed
from tests.test_stored import executed, scans
from tests.test_timeseries import slow_walk


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('keyed')}/t"
    df = spark.range(200_000).select((F.col("id") * 2).alias("order_id"), F.sha1(F.col("id").cast("string")).alias("signal_id"), (F.col("id") % 7).alias("x"))
    keyed.write_keyed(df.repartition(8), path, ["order_id", "signal_id"], group_bytes=256 << 10, group_keys=20_000, partitions=4)
    return path


def read_rows(df):
    """Rows that came out of the scan's row groups."""
    (scan,) = [s for s in scans(executed(df))][:1]
    return scan.metrics().apply("numOutputRows").value()


def test_sorted_keys_rule_row_groups_out(spark, table):
    one = keyed.look_up(spark, table, "order_id", [77_776])
    assert [(r.order_id, r.x) for r in one.collect()] == [(77_776, 38_888 % 7)]
    assert 0 < read_rows(one) < 30_000
    assert read_rows(keyed.look_up(spark, table, "order_id", [77_777])) == 0  # between others, ruled out by the filter
    assert read_rows(keyed.look_up(spark, table, "order_id", [-5, 10**9])) == 0


def test_filters_rule_row_groups_out(spark, table):
    wanted = [hashlib.sha1(str(i).encode()).hexdigest() for i in (5, 150_000)]
    found = keyed.look_up(spark, table, "signal_id", [*wanted, "none", None, wanted[0]])
    assert sorted(r.order_id for r in found.collect()) == [10, 300_000]
    assert 0 < read_rows(found) < 60_000
    assert read_rows(keyed.look_up(spark, table, "signal_id", ["f" * 40, "0" * 40])) == 0


def test_look_ups_of_tables_and_of_nothing(spark, table):
    values = spark.createDataFrame([(10,), (10,), (12,), (13,), (None,)], "order_id long")
    got = keyed.look_up_all(spark, table, "order_id", values)
    assert sorted(r.order_id for r in got.collect()) == [10, 12] and read_rows(got) < 30_000
    assert keyed.look_up_all(spark, table, "order_id", values.limit(0)).count() == 0
    assert keyed.look_up(spark, table, "order_id", []).count() == keyed.look_up(spark, table, "order_id", [None]).count() == 0
    with pytest.raises(ValueError):
        keyed.look_up(spark, table, "order_id", range(600))


def test_random_rows_of_a_group_that_is_the_table(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") < 59_990, 1).otherwise(F.col("id")).alias("g")).union(spark.createDataFrame([(60_001, None), (60_002, None)], "id long, g long"))
    got = sampling.random_rows(df.repartition(6), ["g"], 5, ["id"], 3)
    luck = lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest()
    want = {(1, i) for i in sorted(range(59_990), key=luck)[:5]} | {(i, i) for i in range(59_990, 60_000)} | {(None, 60_001), (None, 60_002)}
    assert {(r.g, r.id) for r in got.collect()} == want and got.columns == ["id", "g"]
    plan = executed(got).toString()
    assert plan.count("WindowGroupLimit") >= 3  # the least of each task before the shuffles
    many = sampling.random_rows(df, ["g"], 2_000, ["id"], 3, parts=4)
    assert many.where("g = 1").count() == 2_000
    assert sampling.random_rows(df.limit(0), ["g"], 5, ["id"]).count() == 0


def filings_and_days(rng, n):
    day, filed, rows = dt.date(2000, 1, 31), dt.date(1999, 12, 1), []
    for _ in range(n):
        day += dt.timedelta(rng.choice([1, 1, 1, 2, 3, 25, 70] if rng.random() < 0.2 else [1, 1, 2]))
        if rng.random() < 0.03:
            filed = day
        rows.append((day, filed))
    return rows


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_walk_by_batches_of_any_size(size):
    rng = random.Random(size)
    for _ in range(30):
        rows = filings_and_days(rng, 150)
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.date32()), pa.array([r[1] for r in rows], pa.date32()), pa.array(range(150))], names=["date", "datekey", "x"])
        got = [d for b in sampling.walk_batches((batch.slice(i, size) for i in range(0, 150, size)), 20) for d in b.column("date").to_pylist()]
        assert sorted(got) == slow_walk([r[0] for r in rows], [r[1] for r in rows], 20)


def test_walk_of_a_long_series_holds_little():
    def batches():
        for k in range(300):
            days = np.arange(k * 1000, (k + 1) * 1000, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(days).cast(pa.date32()), pa.array(days - days % 90).cast(pa.date32()), pa.array(days)], names=["date", "datekey", "x"])

    tracemalloc.start()
    base, most, n = pa.total_allocated_bytes(), 0, 0
    for b in sampling.walk_batches(batches(), 20):
        n += b.num_rows
        most = max(most, pa.total_allocated_bytes() - base)
    assert n > 9_000 and most < 200_000 and tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()


def test_walk_in_spark(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows = [(t, day(i), day(i - i % 45), i, x) for t in ("a", "b", None) for i in range(0, 200) for x in ("p", "q")] + [("a", None, day(1), 0, "z")]
    df = spark.createDataFrame(rows, "ticker string, date date, datekey date, i int, x string").repartition(5)
    got = sampling.sample_at_filings(df)
    want = slow_walk([day(i) for i in range(200)], [day(i - i % 45) for i in range(200)], 20)
    assert sorted((r.ticker or "", r.date, r.x) for r in got.collect()) == sorted((t, d, x) for t in ("", "a", "b") for d in want for x in ("p", "q"))
    assert executed(got).toString().count("Exchange hashpartitioning") <= 2  # one, shown in the initial and the final plan
    assert sampling.sample_at_filings(df.limit(0)).count() == 0


def test_callbacks_get_all_tables_of_a_key(spark):
    main = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), (None, 9)], "k string, v int")
    one = spark.createDataFrame([("a", 5), ("c", 6), (None, 7), ("a", 4)], "k string, v int")
    two = spark.createDataFrame([("b", "x", [1, 2])], "k string, name string, v array<int>")

    def count(k, left, sides):
        assert sides["two"].column_names == ["k", "name", "v"]
        return pa.Table.from_pylist([{"k": k[0], "main": left.num_rows, "one": sides["one"].column("v").to_pylist(), "two": sides["two"].num_rows}])

    schema = "k string, main int, one array<int>, two int"
    got = callbacks.with_sides(main, {"one": one, "two": two}, ["k"], count, schema, {"one": ["v"]})
    fixed = lambda df: sorted(((r.k or "", r.main, r.one, r.two) for r in df.collect()))
    assert fixed(got) == [("", 1, [7], 0), ("a", 2, [4, 5], 0), ("b", 1, [], 1)]
    every = callbacks.with_sides(main, {"one": one, "two": two}, ["k"], count, schema, {"one": ["v"]}, only_main=False)
    assert fixed(every) == [("", 1, [7], 0), ("a", 2, [4, 5], 0), ("b", 1, [], 1), ("c", 0, [6], 0)]
    assert callbacks.with_sides(main.limit(0), {"one": one, "two": two}, ["k"], count, schema).count() == 0


def test_trailing_stops_by_hand(spark):
    day = lambda i: dt.date(2020, 1, i)
    bars = spark.createDataFrame([("a", day(i), c) for i, c in ((2, 10.0), (3, 12.0), (4, 8.0), (5, 5.0), (7, 6.0), (8, 4.0))] + [("a", day(6), None)], "ticker string, date date, close double")
    filings = spark.createDataFrame([("a", day(1)), ("a", day(6)), ("a", None)], "ticker string, datekey date")
    samples = spark.createDataFrame([("a", day(i)) for i in (1, 3, 4, 5, 6, 7, 8)] + [("none", day(3)), ("a", None)], "ticker string, date date")
    got = {(r.ticker, r.date.day): (r.stops, None if r.drawdown is None else round(r.drawdown, 4)) for r in callbacks.trailing_stops(samples, bars, filings).collect()}
    assert got == {("a", 1): (None, None), ("a", 3): (0, 0.0), ("a", 4): (1, 0.0), ("a", 5): (2, 0.0), ("a", 6): (2, 0.0), ("a", 7): (0, 0.0), ("a", 8): (1, 0.0), ("none", 3): (None, None)}
