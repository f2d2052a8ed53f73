"""Small Spark helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: rows that one bucket of a running total holds on average, and buckets in a group of them
BUCKET_ROWS, GROUP_BUCKETS = 2_000, 1_000
#: bytes of a table's rows that may be broadcast
MEMORY_BYTES = 32 << 20
#: keys whose rows may be split (their table is broadcast)
SPLIT_KEYS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for all executors in spark.checkpoint.dir.

    Where it names none, a local session (tests) takes a temporary folder of the one machine there is; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast only if its rows take at most ``MEMORY_BYTES``.

    ``row_bytes`` is what the variable columns of a row take; fixed ones and Java's own count for 100 bytes.
    """
    each = F.lit(100) + (F.lit(0) if row_bytes is None else F.coalesce(row_bytes, F.lit(0)))
    held = df.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= MEMORY_BYTES else df


def join_split(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", part_rows: int = BUCKET_ROWS) -> DataFrame:
    """Equi-join in which one key may hold any share of the rows of ``many``; keys are not null.

    Keys with many rows are cut into parts by a hash of the row, and their rows of ``few`` are repeated for each
    part. A part has ``part_rows`` rows, more where that would make over ``SPLIT_KEYS`` parts.
    """
    n = many.count()
    limit = max(part_rows, -(-n // SPLIT_KEYS))
    counts = many.groupBy(*keys).count().where(F.col("count") > limit)
    split = F.broadcast(materialise(counts.select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("_parts"))))  # at most SPLIT_KEYS rows
    part = F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_parts")), F.lit(0)).cast("int")
    cut = many.join(split, keys, "left").withColumn("_part_", part).drop("_parts")
    spread = few.join(split, keys, "left").withColumn("_part_", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return cut.join(spread, [*keys, "_part_"], how).drop("_part_")


def schema_with(df: DataFrame, keep: tuple[str, ...], more: str) -> StructType:
    """The fields ``keep`` of a table, then those of a DDL string."""
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(more)])


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the memory of Arrow batches that hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def buckets_for(rows: int) -> int:
    """How many buckets a two-level running total over so many rows takes."""
    return max(1, -(-rows // BUCKET_ROWS))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one with the same keys.

    The order is a hash of the ``order`` columns, then these columns. No window holds all rows of a key:
    rows are dealt to ``buckets`` hash buckets; groups of buckets, buckets of a group, and rows of a bucket are each added up in
    windows of their own. Rows equal in all ``order`` columns share a bucket and still get distinct ranges.
    """
    before = (Window.unboundedPreceding, -1)
    sum_before = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*before)), F.lit(0))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum")).withColumn("_group", F.floor(F.col("_bucket") / GROUP_BUCKETS))
    starts = sums.select(*keys, "_bucket", "_group", sum_before("_sum", [*keys, "_group"], ["_bucket"]).alias("_start"))
    if buckets > GROUP_BUCKETS:
        groups = sums.groupBy(*keys, "_group").agg(F.sum("_sum").alias("_sum"))
        starts = starts.join(groups.select(*keys, "_group", sum_before("_sum", keys, ["_group"]).alias("_base")), [*keys, "_group"]).withColumn("_start", F.col("_start") + F.col("_base")).drop("_base")
    inside = sum_before(value, [*keys, "_bucket"], order)
    return dealt.join(starts.drop("_group"), [*keys, "_bucket"]).withColumn(out, F.col("_start") + inside).drop("_bucket", "_start")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def row_key(row_id: Column, text: Column) -> Column:
    """What stands for a row: its id and a hash of its text."""
    return F.concat_ws("|", F.coalesce(row_id.cast("string"), F.lit("null")), F.hex(F.xxhash64(F.coalesce(text, F.lit("")))))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (a, b long): (node, component) with the smallest node as component.

    Alternates two steps until nothing changes: every node passes the smallest of its neighbours to its
    larger neighbours, then to all of them. Both keep connectivity, and paths at least halve, so long
    chains take few rounds. Each round is written to the shared folder. The least node of a large component is a
    frequent key of inner joins that a shuffle follows: there Spark's adaptive execution splits its rows over tasks, and
    all other steps combine before they shuffle.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialise(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(edges.select("b", F.col("b")).distinct())
