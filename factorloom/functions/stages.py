"""Intermediate results: named stages that outlive an application, tables of one application, and row numbers over whole tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
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


class Folder:
    """A folder in any store that Spark reaches, for the few small files and moves that a manifest needs."""

    def __init__(self, spark: SparkSession, where: str) -> None:
        self.jvm, self.where = spark._jvm, where.rstrip("/")
        self.store = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}" if name else self.where)

    def names(self, name: str = "") -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.store.listStatus(at)) if self.store.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.store.exists(self.path(name))

    def read(self, name: str) -> str:
        with_stream = self.store.open(self.path(name))
        try:
            return bytes(with_stream.readAllBytes()).decode()
        finally:
            with_stream.close()

    def put(self, name: str, text: str) -> bool:
        """Write a file that doesn't exist, whole or not at all; False if it does by now."""
        part = self.path(f".{name.replace('/', '_')}-{uuid.uuid4().hex}")
        out = self.store.create(part, True)
        out.write(text.encode())
        out.close()
        self.store.mkdirs(self.path(name).getParent())
        try:
            done = not self.exists(name) and self.store.rename(part, self.path(name))
        finally:
            if self.store.exists(part):
                self.store.delete(part, False)
        return bool(done)

    def remove(self, name: str) -> None:
        self.store.delete(self.path(name), True)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of names, lengths and times of all files under the paths: it changes when an input is written anew."""
    seen = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            seen.append([path, "missing"])
            continue
        files = store.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return hashlib.sha256(json.dumps(sorted(seen, key=repr)).encode()).hexdigest()


class StageStore:
    """Results of named stages in a folder, kept from one application to the next.

    A log of numbered versions holds the manifest: for each stage its digest of inputs and parameters, schema, state and folder. A
    version is one file that is put in place by a rename, and its number is taken once, so a reader sees a whole manifest and writers
    that meet try again. A stage's rows are complete before the manifest names them. On stores without atomic renames, one
    application at a time may write.
    """

    LOG, TABLES, VERSIONS = "_log", "tables", 5

    def __init__(self, spark: SparkSession, where: str) -> None:
        self.spark, self.folder = spark, Folder(spark, where)

    def version(self) -> int:
        names = [n for n in self.folder.names(self.LOG) if n.endswith(".json")]
        return int(names[-1].removesuffix(".json")) if names else 0

    def manifest(self) -> dict[str, dict[str, Any]]:
        v = self.version()
        return json.loads(self.folder.read(f"{self.LOG}/{v:010d}.json")) if v else {}

    def update(self, change: Callable[[dict[str, dict[str, Any]]], None], tries: int = 20) -> dict[str, dict[str, Any]]:
        """The next version of the manifest: the last one as ``change`` leaves it."""
        for _ in range(tries):
            v, held = self.version(), self.manifest()
            change(held)
            if self.folder.put(f"{self.LOG}/{v + 1:010d}.json", json.dumps(held, indent=1, sort_keys=True)):
                return held
            time.sleep(0.05)
        raise RuntimeError(f"other writers took {tries} versions of {self.folder.where}")

    def digest(self, inputs: Iterable[str], stages: Iterable[str], parameters: dict[str, Any]) -> str:
        held = self.manifest()
        before = {s: held.get(s, {}).get("digest") for s in stages}
        return hashlib.sha256(json.dumps([fingerprint(self.spark, *inputs), before, parameters], sort_keys=True, default=str).encode()).hexdigest()

    def complete(self, name: str, digest: str | None = None) -> dict[str, Any] | None:
        """The manifest's entry of a stage that is complete, of this digest if one is given, and whose rows are there."""
        e = self.manifest().get(name)
        fits = e and e["state"] == "complete" and digest in (None, e["digest"]) and self.folder.exists(f"{e['folder']}/_SUCCESS")
        return e if fits else None

    def read(self, name: str) -> DataFrame:
        e = self.complete(name)
        if not e:
            raise KeyError(name)
        return self.spark.read.schema(StructType.fromJson(e["schema"])).parquet(f"{self.folder.where}/{e['folder']}")

    def stage(self, name: str, build: Callable[[], DataFrame], inputs: Iterable[str] = (), stages: Iterable[str] = (), parameters: dict[str, Any] | None = None) -> DataFrame:
        """The result of a stage: read if it was built from these inputs (paths), stages and parameters, else built now.

        The manifest says ``building`` while it runs. Tables that ``build`` stages go once its result is written. A build that dies leaves a folder that no complete stage names: the next call builds
        anew and ``clean`` removes it. What ``build`` itself does isn't known here; put a version of it among the parameters.
        """
        inputs, stages, parameters = sorted(inputs), sorted(stages), parameters or {}
        digest = self.digest(inputs, stages, parameters)
        if not self.complete(name, digest):
            where = f"{self.TABLES}/{name}-{digest[:12]}-{uuid.uuid4().hex[:8]}"
            entry = {"digest": digest, "inputs": inputs, "stages": stages, "parameters": json.loads(json.dumps(parameters, default=str)), "folder": where, "started": time.time()}
            self.update(lambda m: m.update({name: entry | {"state": "building"}}))
            with passing(self.spark):
                df = build()
                write(df, f"{self.folder.where}/{where}")
            self.update(lambda m: m.update({name: entry | {"state": "complete", "schema": json.loads(df.schema.json()), "finished": time.time()}}))
        return self.read(name)

    def state(self) -> DataFrame:
        """The manifest as a table: stage, state, digest, inputs, stages, parameters, schema, folder."""
        rows = [(n, e["state"], e["digest"], e["inputs"], e["stages"], json.dumps(e["parameters"]), json.dumps(e.get("schema")), e["folder"]) for n, e in sorted(self.manifest().items())]
        return self.spark.createDataFrame(rows, "stage string, state string, digest string, inputs array<string>, stages array<string>, parameters string, schema string, folder string")

    def drop(self, *names: str) -> None:
        """Take stages off the manifest; ``clean`` removes their rows."""
        self.update(lambda m: [m.pop(n, None) for n in names])

    def clean(self, building_hours: float = 24) -> list[str]:
        """Remove rows that no stage names, builds that began over ``building_hours`` ago and have not ended, and old versions of the log.

        Frames over a removed table no longer run: call this when no job reads the folder.
        """
        old = time.time() - 3600 * building_hours
        kept = self.update(lambda m: [m.pop(n) for n in [n for n, e in m.items() if e["state"] == "building" and e["started"] <= old]])
        named = {e["folder"] for e in kept.values()}
        gone = [f"{self.TABLES}/{n}" for n in self.folder.names(self.TABLES) if f"{self.TABLES}/{n}" not in named]
        gone += [f"{self.LOG}/{n}" for n in self.folder.names(self.LOG)[: -self.VERSIONS]]
        gone += [n for n in self.folder.names() if n.startswith(".") and n.removeprefix(".").startswith(self.LOG)]
        for name in gone:
            self.folder.remove(name)
        return gone


def stages_of(spark: SparkSession) -> StageStore:
    """The store in the shared folder."""
    return StageStore(spark, f"{shared_folder(spark)}/stages")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's anonymous tables; it goes when the driver's JVM ends in order."""
    where = f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"
    folder = Folder(spark, where)
    if not folder.store.exists(folder.path("")):
        folder.store.mkdirs(folder.path(""))
        folder.store.deleteOnExit(folder.path(""))
    return where


def clean_runs(spark: SparkSession, hours: float = 48) -> list[str]:
    """Remove the tables of other applications that have written none for so long: what a killed driver left."""
    shared = Folder(spark, shared_folder(spark))
    own, old = f"run-{spark.sparkContext.applicationId}", (time.time() - 3600 * hours) * 1000
    gone = [n for n in shared.names() if n.startswith("run-") and n != own and shared.store.getFileStatus(shared.path(n)).getModificationTime() <= old]
    for n in gone:
        shared.remove(n)
    return gone


#: whether Spark removes a query's shuffle files as soon as it is done
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: the tables that each open scope of a thread has staged, innermost scope last
_OPEN = threading.local()


def write(df: DataFrame, path: str) -> None:
    """Write a table whose steps nothing else reads: its shuffle files go at once, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)


def _scopes() -> list[list[str]]:
    if not hasattr(_OPEN, "scopes"):
        _OPEN.scopes = []
    return _OPEN.scopes


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A scope whose staged tables are removed when it ends; what is made of them has to be written by then."""
    made: list[str] = []
    _scopes().append(made)
    try:
        yield
    finally:
        _scopes().pop()
        if made:
            folder = Folder(spark, run_folder(spark))
            for path in made:
                folder.remove(path.rsplit("/", 1)[1])


def _kept(df: DataFrame, path: str) -> DataFrame:
    """A written table of the innermost open scope, read back."""
    if _scopes():
        _scopes()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """Write a step's result to the shared folder and read it back, so later steps don't repeat it."""
    path = f"{run_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    write(df, path)
    return _kept(df, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``staged`` for what ``build`` makes; the tables that it stages on the way are removed, so only the result takes disk."""
    path = f"{run_folder(spark)}/stage-{uuid.uuid4().hex}"
    with passing(spark):
        df = build()
        write(df, path)
    return _kept(df, path)


def resumed(spark: SparkSession, name: str, build: Callable[[], DataFrame], inputs: Iterable[str] = (), parameters: dict[str, Any] | None = None) -> DataFrame:
    """A stage of the shared store, whichever application built it: stale as soon as an input or parameter changes."""
    return stages_of(spark).stage(name, build, inputs, (), parameters)


def with_ordinal(df: DataFrame, order: list[str], out: str = "ordinal") -> DataFrame:
    """Add a gapless number from 0 in the given order without sorting all rows in one task.

    Rows are dealt to ranges of all ``order`` columns and written, so that a range stays what it is; the ranges' counts, as
    few as there are tasks, give each its start. Rows equal in these columns share a range and are numbered in any order.
    """
    placed = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").count()
    starts = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return placed.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.row_number().over(inside) - 1).drop("_part", "_start")
