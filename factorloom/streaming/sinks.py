"""A table that a stream fills with exactly-once effect, and how far it has come."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from factorloom.functions.stages import Folder


class EmittedTable:
    """Rows of a stream by micro-batch, with a ledger of the batches that count.

    A batch is written to a folder of its number and then entered in the ledger, with its rows and the event time that the table
    has emitted until. A batch that is run again after a failure finds its entry and does nothing, or finds none and writes its folder anew;
    readers take the folders in the ledger. The stream's own checkpoint is kept beside them, so numbers can't start over under
    a table that has rows. Rows at or before the emitted-until of the batches before theirs have ``late`` set; each is there once, like all others.
    """

    LEDGER, BATCHES, LOG = "_ledger", "batches", "checkpoint"

    def __init__(self, spark: SparkSession, where: str, time_col: str) -> None:
        self.spark, self.folder, self.time_col = spark, Folder(spark, where), time_col

    def entries(self) -> list[dict[str, Any]]:
        """The ledger in order of batches."""
        return [json.loads(self.folder.read(f"{self.LEDGER}/{n}")) for n in self.folder.names(self.LEDGER) if n.endswith(".json")]

    def emitted_until(self, before: int | None = None) -> datetime | None:
        """The greatest event time of the table, or of its batches under a number; null for none."""
        times = [e["until"] for e in self.entries() if e["until"] and (before is None or e["batch"] < before)]
        return datetime.fromisoformat(max(times)) if times else None

    def batch_path(self, batch: int) -> str:
        return f"{self.folder.where}/{self.BATCHES}/{batch:010d}"

    def write(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch: written, then entered; both may be repeated after a failure at any point."""
        entry = f"{self.LEDGER}/{batch:010d}.json"
        if self.folder.exists(entry):
            return
        until = self.emitted_until(batch)
        late = F.lit(False) if until is None else F.coalesce(F.col(self.time_col) <= F.lit(until), F.lit(False))
        rows.withColumn("late", late).write.mode("overwrite").parquet(self.batch_path(batch))
        n, most = self.spark.read.parquet(self.batch_path(batch)).agg(F.count("*"), F.max(F.col(self.time_col).cast("timestamp").cast("timestamp_ntz"))).first()
        self.enter(entry, {"batch": batch, "rows": n, "until": most.isoformat(timespec="microseconds") if most else None})

    def enter(self, name: str, entry: dict[str, Any]) -> None:
        self.folder.put(name, json.dumps(entry))

    def start(self, stream: DataFrame, prepare: Callable[[DataFrame], DataFrame] | None = None, **trigger: Any) -> StreamingQuery:
        """Run the stream into the table; ``prepare`` is applied to each batch. Restarts go on where the last run ended."""

        def each(rows: DataFrame, batch: int) -> None:
            self.write(prepare(rows) if prepare else rows, batch)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder.where}/{self.LOG}").trigger(**(trigger or {"availableNow": True})).start()

    def read(self, schema: StructType) -> DataFrame:
        """The rows that count, of this schema, with ``late``."""
        paths = [self.batch_path(e["batch"]) for e in self.entries()]
        kind = StructType([*schema.fields]).add("late", "boolean")
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def between(self, schema: StructType, after: datetime | None, upto: datetime) -> DataFrame:
        """What a consumer that has seen all until ``after`` gets next: rows after it and up to ``upto``."""
        rows = self.read(schema).where(F.col(self.time_col) <= F.lit(upto))
        return rows if after is None else rows.where(F.col(self.time_col) > F.lit(after))
