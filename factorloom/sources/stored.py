"""Tables stored for the windows and joins that read them: bucketed by key, sorted, and in folders that joins prune."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.functions.stages import Folder

LAYOUT = "_layout.json"
#: bytes of a bucket that a task sorts without spilling on usual executors
BUCKET_BYTES = 512 << 20


def buckets_for(size: int, least: int = 1, most: int = 100_000) -> int:
    """How many buckets a table of so many bytes takes."""
    return max(least, min(most, -(-size // BUCKET_BYTES)))


def store(df: DataFrame, path: str, key: str, order: Sequence[str], buckets: int, folder: str | None = None) -> DataFrame:
    """Write a table in ``buckets`` files by a hash of ``key``, each sorted by key and ``order``, and read it back as stored.

    Tables of equal ``buckets`` and key are co-located: windows, aggregates and joins by the key run on them without a
    shuffle, in this application and, through ``stored``, in later ones. With ``folder`` (a column of few values, such as a year) each of its values has
    a folder with the buckets inside, and filters and joins on it leave folders unread. One shuffle, here, is
    what it costs. The path must not hold a table yet.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, key).sortWithinPartitions(*([folder] if folder else []), key, *order)
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path)
    (writer.partitionBy(folder) if folder else writer).saveAsTable(_name(path))
    layout = {"key": key, "order": list(order), "buckets": buckets, "folder": folder, "schema": json.loads(df.schema.json())}
    if not Folder(spark, path).put(LAYOUT, json.dumps(layout)):
        raise FileExistsError(path)
    return spark.table(_name(path))


def _name(path: str) -> str:
    return f"stored_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``store`` wrote, in this or an earlier application, with its buckets and folders known to the planner."""
    if not spark.catalog.tableExists(_name(path)):
        layout = json.loads(Folder(spark, path).read(LAYOUT))
        fields = {f.name: f for f in StructType.fromJson(layout["schema"])}
        columns = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in fields.items())
        order = ", ".join(f"`{c}`" for c in [layout["key"], *layout["order"]])
        parts = f"PARTITIONED BY (`{layout['folder']}`)" if layout["folder"] else ""
        spark.sql(f"CREATE TABLE {_name(path)} ({columns}) USING parquet {parts} CLUSTERED BY (`{layout['key']}`) SORTED BY ({order}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
        if layout["folder"]:
            spark.catalog.recoverPartitions(_name(path))
    return spark.table(_name(path))


def in_spans(df: DataFrame, spans: DataFrame, date_col: str = "date", folder: str = "year") -> DataFrame:
    """Rows whose date is in one of the spans (first, last; both included): each row once, however many spans it is in.

    The spans' years are joined with the folders of ``df``, so at run time only these folders are opened; spans are a table of a
    few rows, such as folds, that may itself come from a query.
    """
    years = spans.select(F.explode(F.sequence(F.year("first"), F.year("last"))).alias(folder), "first", "last").where("last >= first")
    by_year = years.groupBy(folder).agg(F.collect_set(F.struct("first", "last")).alias("_spans")).where(F.size("_spans") > 0)
    within = F.exists("_spans", lambda s: F.col(date_col).between(s["first"], s["last"]))
    return df.join(F.broadcast(by_year), folder).where(within).select(*df.columns)  # a row a year
