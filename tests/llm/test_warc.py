"""WARC archives: round trips, the plain choice of responses, equal files on every run, torn writes and damaged files."""

import base64
import gzip
import hashlib
import io
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factorloom.llm import warc

SCHEMA = "page_id long, url string, html string, shard int, digest string, size long, id string, payload string, hot int, first_id int"


def awkward():
    rng = random.Random(4)
    texts = [None, "", "a", "é語😀\r\n\r\nWARC/1.1\r\n\r\n", "x" * 300_000] + ["".join(rng.choices("abé \r\n", k=rng.randint(1, 900))) for _ in range(40)]
    rows = [(i, f"http://e.org/{i}?q=a b\r\nX: é", t) for i, t in enumerate(texts)]
    rows += [(1000 - i, None if i % 7 == 0 else f"http://h.org/{i % 40}", "a page that a third of all rows have") for i in range(400)]
    rows += [(5, "http://e.org/5", texts[7]), (5, "http://e.org/4", texts[7]), (None, "u", texts[8]), (None, None, "only without id"), (None, None, "only without id"), (20, "u", texts[9])]
    rows += [rows[12], rows[12]]
    return [(*r, 1, "d", 2, "i", "p", 3, 4) for r in rows]


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by hand."""
    groups: dict[bytes, list] = {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r[0])
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.sort(key=lambda x: (x is None, x))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= least
            out.append((i, len(payload), digest, "revisit" if again else "response", ids[0] if again else None))
    return Counter(out)


def found(df):
    return Counter((None if r.id is None else int(r.id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in df.collect())


def archives(folder):
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if os.path.isfile(f"{folder}/{n}")}


@pytest.mark.parametrize("least, shard_bytes, roll", [(0, 16 << 20, 1 << 28), (0, 60_000, 3_000), (37, 20_000, 1), (10, 100_000, 20_000)])
def test_round_trip(spark, tmp_path, monkeypatch, least, shard_bytes, roll):
    monkeypatch.setattr(warc, "BUCKET_ROWS", 50)  # so that the frequent page gets shards of its own
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(5)
    path = f"file://{tmp_path}/out"
    warc.write_warc(df, path, least_revisit=least, shard_bytes=shard_bytes, roll_bytes=roll)
    back = warc.read_warc(spark, path)
    assert found(back) == expected(awkward(), least)
    assert found(warc.read_warc(spark, path, payload=False)) == expected(awkward(), least)
    rows = back.collect()
    assert len({r.record_id for r in rows}) == len(rows)
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        if r.record_type == "revisit":
            first = by_id[r.refers_to_record]
            assert (first.record_type, first.payload_digest, first.id) == ("response", r.payload_digest, r.refers_to)
        else:
            assert len(r.payload) == r.payload_bytes
    payloads = {(r[2] or "").encode() for r in awkward()}
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == payloads
    files = {n: b for n, b in archives(tmp_path / "out").items() if n.endswith(".gz")}
    assert roll > 1 or len(files) == len(rows)
    for name, data in files.items():  # the standard library reads them, and each name ends with its digest
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and hashlib.sha1(data).hexdigest()[:12] in name
        assert len(data) <= roll or sum(1 for _ in warc.records(io.BytesIO(data))) == 2


def test_files_roll_by_their_size(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefgh", k=2000))) for i in range(300)], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/out", roll_bytes=50_000)
    sizes = [f["bytes"] for f in json.loads((tmp_path / "out" / warc.MANIFEST).read_bytes())["files"]]
    assert len(sizes) > 5 and all(s <= 50_000 for s in sizes) and all(s > 40_000 for s in sizes[:-1])


def test_same_rows_same_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUCKET_ROWS", 50)
    df = spark.createDataFrame(awkward(), SCHEMA)
    warc.write_warc(df.repartition(7), f"file://{tmp_path}/a", shard_bytes=50_000, roll_bytes=9_000)
    warc.write_warc(df.orderBy(F.desc("html")).coalesce(2), f"file://{tmp_path}/b", shard_bytes=50_000, roll_bytes=9_000)
    assert archives(tmp_path / "a") == archives(tmp_path / "b") and len(archives(tmp_path / "a")) > 10


def test_a_write_replaces_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    df = spark.createDataFrame(awkward(), SCHEMA)
    warc.write_warc(df, path)
    before = archives(tmp_path / "out")
    broken = df.withColumn("html", F.when(F.col("page_id") == 990, F.raise_error(F.lit("lost"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="lost"):
        warc.write_warc(broken, path)
    assert archives(tmp_path / "out") == before
    warc.write_warc(df.where("page_id < 3"), path)
    assert found(warc.read_warc(spark, path)) == expected([r for r in awkward() if r[0] is not None and r[0] < 3])
    assert not set(archives(tmp_path / "out")) & {n for n in before if n.endswith(".gz")}
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0 and [n for n in archives(tmp_path / "out")] == [warc.MANIFEST]


def test_tasks_that_ran_twice_count_once(tmp_path):
    import pyarrow as pa

    digest = hashlib.sha1(b"x").digest()
    batch = pa.RecordBatch.from_pylist([{"shard": 0, "id": "1", "url": "u", "digest": digest, "size": 1, "payload": b"x", "hot": False, "first_id": None, "first_url": None}])
    writer = warc.WarcWriter({"path": f"file://{tmp_path}/out"})
    writer.write(iter([batch]))  # its executor is lost after the write
    writer.commit([writer.write(iter([batch])), None])
    names = os.listdir(tmp_path / "out")
    assert sorted(names) == [warc.MANIFEST, next(n for n in names if n.endswith(".warc.gz"))]
    with pytest.raises(ValueError, match="lacks its payload"):
        writer.write(iter([pa.RecordBatch.from_pylist([batch.to_pylist()[0] | {"payload": b"y"}])]))


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame(awkward()[:30], SCHEMA)
    warc.write_warc(df, f"file://{tmp_path}/out")
    (name,) = [n for n in os.listdir(tmp_path / "out") if n.endswith(".gz")]
    data = (tmp_path / "out" / name).read_bytes()
    (tmp_path / "out" / name).write_bytes(data[:-40])
    with pytest.raises(Exception, match="manifest"):
        warc.read_warc(spark, f"file://{tmp_path}/out").count()
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(io.BytesIO(data[:-40])))
    plain = gzip.decompress(data)
    for bad in (plain.replace(b"200 OK", b"200 KO"), plain.replace(b"WARC/1.1\r\nWARC-Type: resp", b"HARC/1.1\r\nWARC-Type: resp", 1)):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(gzip.compress(bad))))
    assert len(list(warc.records(io.BytesIO(gzip.compress(plain))))) == 31  # one member for all records is read as well


def test_other_keys(spark, tmp_path):
    df = spark.createDataFrame([("b%/é", "u", "same"), ("a", None, "same"), (None, None, None)], "k string, u string, body string")
    warc.write_warc(df, f"file://{tmp_path}/out", "k", "u", "body")
    got = {(r.id, r.record_type, r.refers_to) for r in warc.read_warc(spark, f"file://{tmp_path}/out").collect()}
    assert got == {("a", "response", None), ("b%/é", "revisit", "a"), (None, "response", None)}
    with pytest.raises(Exception, match="overwrite"):
        df.write.format("warc").option("path", f"file://{tmp_path}/out").mode("append").save()
