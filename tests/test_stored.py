"""Tables stored in buckets and folders: plans without a shuffle, pruned folders, equal rows, later applications."""

import datetime
import re
import uuid

import pytest
from pyspark.sql import functions as F

from factorloom.operators import asof
from factorloom.plans import stored_queries
from factorloom.sources import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return stored_queries.store_all(spark, SF, 4)


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan()


def scans(node):
    """File scans of an executed plan."""
    name = node.nodeName()
    if "AdaptiveSparkPlan" in name:
        return scans(node.executedPlan())
    if "QueryStage" in name:
        return scans(node.plan())
    children = node.children()
    return [node] * name.startswith("Scan parquet") + [x for i in range(children.size()) for x in scans(children.apply(i))]


@pytest.mark.parametrize("broadcast", [10 << 20, -1])
def test_windows_and_joins_do_not_shuffle(spark, tables, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    plan = executed(stored_queries.windows_over(tables)).toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan) == (broadcast < 0)
    assert "Exchange hashpartitioning" not in plan and plan.count("Window [") >= 3 and "Bucketed: true" in plan


def test_listed_filings_are_those_of_the_running_maximum(spark, tables):
    bars, filings = tables["bars"].drop("year"), tables["filings"]
    a, b = asof.attach_filings(bars, filings), asof.attach_filings_listed(bars, filings)
    assert a.columns == b.columns and a.count() == b.count() > 0 and a.exceptAll(b).count() == 0
    day = datetime.date
    few = spark.createDataFrame([("a", day(2000, 1, d)) for d in (1, 5, 9)] + [("b", day(2000, 1, 1)), (None, day(2000, 1, 1))], "ticker string, date date")
    filed = spark.createDataFrame([("a", day(1999, 9, 30), day(2000, 1, 5), 1.0, 1.0), ("a", day(1999, 12, 31), day(2000, 1, 9), 2.0, 1.0), ("a", day(1999, 6, 30), day(2000, 1, 9), 3.0, 1.0), ("a", day(1999, 12, 31), None, 4.0, 1.0), ("b", None, day(1999, 1, 1), 5.0, 1.0)], "ticker string, calendardate date, datekey date, sharesbas double, sharefactor double")
    for f in (asof.attach_filings, asof.attach_filings_listed):
        assert [(r.ticker, r.date.day, r.sharesbas, r.age) for r in f(few, filed).orderBy("date").collect()] == [("a", 5, 1.0, 0), ("a", 9, 2.0, 0)]


def test_folders_are_pruned_by_a_join(spark, tables):
    bars = tables["bars"]
    every = bars.select("year").distinct().count()
    spans = stored_queries.fold_spans(bars).where("fold = 2")
    out = stored.in_spans(bars, spans)
    first, last = spans.select("first", "last").first()
    node = executed(out)
    read = [s.metrics().apply("numPartitions").value() for s in scans(node) if "dynamicpruning" in s.toString()]
    assert read == [last.year - first.year + 1] and read[0] < every
    assert out.count() == bars.where(F.col("date").between(first, last)).count() > 0


def test_spans_that_overlap_give_rows_once(spark, tables):
    bars, day = tables["bars"], datetime.date
    spans = spark.createDataFrame([(day(1995, 1, 1), day(1996, 6, 30)), (day(1996, 3, 1), day(1996, 12, 31)), (day(1997, 5, 1), day(1997, 4, 1)), (day(2050, 1, 1), day(2051, 1, 1))], "first date, last date")
    assert stored.in_spans(bars, spans).exceptAll(bars.where("date between '1995-01-01' and '1996-12-31'")).count() == 0
    assert stored.in_spans(bars, spans).count() == bars.where("date between '1995-01-01' and '1996-12-31'").count()
    assert stored.in_spans(bars, spans.limit(0)).count() == 0


def test_a_later_application_finds_the_layout(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(1000).select((F.col("id") % 13).cast("string").alias("k"), F.col("id").alias("v"), (2000 + F.col("id") % 3).cast("int").alias("year"))
    stored.store(df, path, "k", ["v"], 3, "year")
    spark.sql(f"DROP TABLE {stored._name(path)}")  # a new application's catalog is empty
    back = stored.stored(spark, path)
    assert back.exceptAll(df).count() == 0 and back.count() == 1000
    plan = executed(back.groupBy("k").agg(F.sum("v"))).toString()
    assert "Exchange" not in plan and re.search(r"SelectedBucketsCount: 3 out of 3", plan)
    with pytest.raises(Exception):
        stored.store(df, path, "k", ["v"], 3)


def test_each_bucket_is_one_sorted_file(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    df = spark.range(5000).select((F.col("id") % 50).alias("k"), (F.col("id") * 7919 % 5000).alias("v")).repartition(6)
    stored.store(df, path, "k", ["v"], 4)
    rows = spark.read.parquet(path).select("*", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("f", "i").collect()
    files = {}
    for r in rows:
        files.setdefault(r.f, []).append((r.k, r.v))
    assert len(files) == 4 and all(x == sorted(x) for x in files.values())
    assert stored.buckets_for(0) == 1 and stored.buckets_for(10 << 40) == 20480
