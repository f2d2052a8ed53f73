"""Stages that outlive an application: resuming, staleness, clean-up, writers that meet."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from factorloom.functions import stages


@pytest.fixture
def store(spark, tmp_path):
    return stages.StageStore(spark, f"file://{tmp_path}/stages")


@pytest.fixture
def source(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def counted(spark, path, calls, times=2):
    def build():
        calls.append(times)
        return spark.read.parquet(path).withColumn("x", F.col("id") * times)

    return build


def test_a_stage_is_built_once(spark, store, source):
    calls = []
    for _ in range(3):
        out = store.stage("doubled", counted(spark, source, calls), [source])
        assert sorted(r.x for r in out.collect()) == list(range(0, 20, 2))
    assert calls == [2]
    again = stages.StageStore(spark.newSession(), store.folder.where)
    again.stage("doubled", counted(spark, source, calls), [source])
    assert calls == [2] and again.read("doubled").count() == 10
    with pytest.raises(KeyError):
        store.read("none")


def test_inputs_parameters_and_stages_make_it_stale(spark, store, source):
    calls = []
    make = lambda times: store.stage("a", counted(spark, source, calls, times), [source], parameters={"times": times})
    after = lambda: store.stage("b", lambda: (calls.append("b"), store.read("a").agg(F.sum("x").alias("s")))[1], stages=["a"]).first().s
    make(2)
    assert after() == 90 and calls == [2, "b"]
    make(3)
    assert after() == 135 and calls == [2, "b", 3, "b"]
    spark.range(5).write.mode("append").parquet(source)
    make(3)
    assert after() == 3 * (45 + 10) and calls[4:] == [3, "b"]
    make(3), after()
    assert len(calls) == 6


def test_clean_leaves_what_the_manifest_names(spark, store, source, tmp_path):
    for times in (2, 3, 4):
        store.stage("a", counted(spark, source, [], times), [source], parameters={"times": times})
    store.stage("b", counted(spark, source, []), [source])
    with pytest.raises(ZeroDivisionError):
        store.stage("c", lambda: 1 // 0, [source])
    folder = tmp_path / "stages"
    assert len(os.listdir(folder / "tables")) == 4
    assert {(r.stage, r.state) for r in store.state().collect()} == {("a", "complete"), ("b", "complete"), ("c", "building")}
    store.clean()
    assert len(os.listdir(folder / "tables")) == 2 and len([n for n in os.listdir(folder / "_log") if n.endswith(".json")]) <= stages.StageStore.VERSIONS + 1
    store.clean(building_hours=0)
    assert [r.stage for r in store.state().collect()] == ["a", "b"]
    assert store.read("a").agg(F.max("x")).first()[0] == 36
    store.drop("a", "b")
    store.clean()
    assert os.listdir(folder / "tables") == [] and store.state().count() == 0


def test_rows_that_are_gone_are_built_again(spark, store, source, tmp_path):
    calls = []
    store.stage("a", counted(spark, source, calls), [source])
    (table,) = os.listdir(tmp_path / "stages" / "tables")
    os.remove(tmp_path / "stages" / "tables" / table / "_SUCCESS")
    assert store.stage("a", counted(spark, source, calls), [source]).count() == 10 and calls == [2, 2]


def test_writers_that_meet_lose_nothing(spark, store):
    other = stages.StageStore(spark, store.folder.where)
    met = []

    def change(held):
        if not met:  # another writer takes the version in between
            met.append(1)
            other.update(lambda m: m.update({"theirs": {"state": "complete", "digest": "", "folder": "t"}}))
        held["mine"] = {"state": "complete", "digest": "", "folder": "m"}

    store.update(change)
    assert set(store.manifest()) == {"theirs", "mine"} and store.version() == 2
    assert not store.folder.put("_log/0000000002.json", "{}")
    assert not [n for n in store.folder.names() if n.startswith(".")]


def test_a_killed_application_is_resumed(spark, store, source, tmp_path):
    """The first application dies in its second stage; the next one runs that stage only."""
    script = f"""
        import os
        from pyspark.sql import SparkSession
        from factorloom.functions.stages import StageStore
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        store = StageStore(spark, "{store.folder.where}")
        store.stage("first", lambda: spark.read.parquet("{source}"), ["{source}"])
        def dies():
            os._exit(9)
        store.stage("second", dies, stages=["first"])
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    died = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], cwd=root, capture_output=True, timeout=240)
    assert died.returncode == 9
    calls = []
    first = store.stage("first", lambda: calls.append("first"), [source])
    second = store.stage("second", lambda: (calls.append("second"), first.where("id > 6"))[1], stages=["first"])
    assert calls == ["second"] and second.count() == 3
    store.clean()
    assert len(os.listdir(tmp_path / "stages" / "tables")) == 2


def test_resumed_and_staged_tables(spark, source):
    calls = []
    for _ in range(2):
        assert stages.resumed(spark, f"t{os.path.basename(os.path.dirname(source))}", counted(spark, source, calls), [source]).count() == 10
    assert calls == [2]
    kept = stages.staged(spark.range(3))
    assert spark.sparkContext.applicationId in kept.inputFiles()[0] and kept.count() == 3
    shared = stages.Folder(spark, stages.shared_folder(spark))
    shared.store.mkdirs(shared.path("run-app-dead/stage-x"))
    assert "run-app-dead" not in stages.clean_runs(spark, hours=1)
    assert stages.clean_runs(spark, hours=-1) == ["run-app-dead"] and kept.count() == 3


def test_fingerprints(spark, source, tmp_path):
    a = stages.fingerprint(spark, source)
    assert a == stages.fingerprint(spark, source) != stages.fingerprint(spark, source, f"{tmp_path}/none")
    spark.range(1).write.mode("append").parquet(source)
    assert stages.fingerprint(spark, source) != a
    assert json.loads(stages.StageStore(spark, f"file://{tmp_path}/s").spark.range(1).schema.json())


def test_tables_staged_on_the_way_go_with_their_scope(spark, store, source):
    """F1, F3, F8-F10: of a build only the result stays on disk, and a written table's shuffle files don't wait for the driver's garbage."""
    before = set(stages.Folder(spark, stages.run_folder(spark)).names())
    held = lambda: set(stages.Folder(spark, stages.run_folder(spark)).names()) - before

    def build():
        first = stages.staged(spark.range(100).repartition(3))
        second = stages.settled(spark, lambda: stages.staged(first.where("id < 50")).groupBy((F.col("id") % 5).alias("k")).count())
        assert len(held()) == 2
        return second.join(stages.staged(spark.range(3)), F.col("k") == F.col("id")).select("k", "count")

    assert sorted(tuple(r) for r in store.stage("scoped", build).collect()) == [(0, 10), (1, 10), (2, 10)] and not held()
    kept = stages.settled(spark, lambda: stages.staged(spark.range(7)).where("id > 2"))
    assert kept.count() == 4 and len(held()) == 1
    with pytest.raises(ZeroDivisionError):
        stages.settled(spark, lambda: stages.staged(spark.range(7)).where(F.lit(1 // 0)))
    assert len(held()) == 1 and not stages._scopes() and spark.conf.get(stages.DROP_SHUFFLES, "false") == "false"
