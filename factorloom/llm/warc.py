"""WARC archives: a deterministic sharded writer and a reader, as a Spark data source.

Records are sorted by the SHA-1 of their payload in ranges of equal width (the digests are even), so equal payloads
follow each other and the first of them becomes the response, the others revisits. A payload with more copies than a shard
has rows gets shards of its own, dealt by a hash of the row, and there only the response carries its payload through the shuffle.
Tasks write under temporary names; the commit moves finished files to their names, which end with their own digests,
and then puts a manifest in place. Readers go by the manifest, so they see all of a write or nothing of it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from factorloom.llm.common import BUCKET_ROWS, materialise

#: payload bytes that a shard holds on average, shards (before those of frequent payloads), compressed bytes of a file
SHARD_BYTES, MOST_SHARDS, ROLL_BYTES = 16 << 20, 20_000, 256 << 20
#: what a record takes beside its payload
RECORD_BYTES = 1_000
#: bytes of records in a batch that a reader hands on
BATCH_BYTES = 8 << 20

MANIFEST, PENDING = "manifest.json", "_pending"
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, id string, refers_to_record string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)
ARROW = pa.schema([(f, {"payload_bytes": pa.int64(), "payload": pa.binary()}.get(f, pa.string())) for f in (x.split()[0] for x in SCHEMA.split(", "))])


# --- records ---------------------------------------------------------------------------------------------------------


def sha1_label(digest: bytes) -> str:
    return f"sha1:{base64.b32encode(digest).decode()}"


def record_name(kind: str, row_id: str | None, url: str | None, digest: bytes, copy: int) -> str:
    """A record's id, from what it is: the same on every run."""
    text = json.dumps([kind, row_id, url, digest.hex(), copy])
    return uuid.UUID(bytes=hashlib.sha1(text.encode()).digest()[:16], version=5).urn


def uri(url: str | None, name: str) -> str:
    """A target URI that fits a header line: the url with blanks, controls and non-ASCII escaped, or the record's own name."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else name


def member(kind: str, fields: dict[str, str | None], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member of its own, lengths and block digest made anew."""
    lines = {"WARC-Type": kind, **fields, "WARC-Block-Digest": sha1_label(hashlib.sha1(block).digest()), "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None)
    pack = zlib.compressobj(level, wbits=31)
    return b"".join((pack.compress(f"WARC/1.1\r\n{head}\r\n".encode()), pack.compress(block), pack.compress(b"\r\n\r\n"), pack.flush()))


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


class Blocks:
    """The bytes of a stream of gzip members, read as they are needed."""

    def __init__(self, raw: Any, step: int = 1 << 20) -> None:
        self.raw, self.step, self.held, self.rest, self.pack = raw, step, bytearray(), b"", zlib.decompressobj(31)
        self.open = False

    def more(self) -> bool:
        if self.pack.eof:
            self.rest, self.pack, self.open = self.pack.unused_data, zlib.decompressobj(31), False
        data = self.rest or self.raw.read(self.step)
        self.rest = b""
        if not data:
            if self.open:
                raise ValueError("the archive ends inside a record")
            return False
        self.open = True
        self.held += self.pack.decompress(data)
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def head(self) -> bytes | None:
        """Bytes up to the next empty line; None at the end."""
        seen = 0
        while (at := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
        return self.take(at + 4)


def records(raw: Any) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of a gzipped archive, block digests verified."""
    stream = Blocks(raw)
    while (head := stream.head()) is not None:
        first, *lines = head[:-4].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        if (said := fields.get("warc-block-digest")) and said != sha1_label(hashlib.sha1(block).digest()):
            raise ValueError(f"block digest of {fields.get('warc-record-id')} is wrong")
        yield fields, block


# --- writer ----------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (temporary name, final name, bytes, records, digest)."""

    files: list[tuple[str, str, int, int, str]]


class RolledFiles:
    """One task's files of a shard after the other, a new one where a record would take the open one beyond its bytes."""

    def __init__(self, store: fs.FileSystem, folder: str, prefix: str, roll: int, opening: bytes) -> None:
        self.store, self.folder, self.prefix, self.roll, self.opening = store, folder, prefix, roll, opening
        self.out, self.shard, self.number = None, None, 0
        self.done: list[tuple[str, str, int, int, str]] = []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        elif self.out is not None and self.size + len(data) > self.roll and self.count:
            self.close()
        if self.out is None:
            self.temporary = f"{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.count, self.sha = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None), 0, 0, hashlib.sha1()
            self.put(self.opening)
        self.put(data)
        self.count += 1

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            digest = self.sha.hexdigest()
            self.done.append((self.temporary, f"{self.prefix}-{self.shard:06d}-{self.number:04d}-{digest[:12]}.warc.gz", self.size, self.count, digest))
            self.out, self.number = None, self.number + 1


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.prefix, self.date = options["path"], options.get("prefix", "pages"), options.get("date", "2000-01-01T00:00:00Z")
        self.roll, self.least, self.job = int(options.get("rollbytes", ROLL_BYTES)), int(options.get("leastrevisit", 0)), uuid.uuid4().hex

    def where(self) -> tuple[fs.FileSystem, str, str]:
        store, folder = fs.FileSystem.from_uri(self.path)
        return store, folder, f"{folder}/{PENDING}/{self.job}"

    def opening(self) -> bytes:
        block = b"software: factorloom\r\nformat: WARC File Format 1.1\r\n"
        return member("warcinfo", {"WARC-Record-ID": record_name("warcinfo", self.prefix, self.date, b"", 0), "WARC-Date": self.date, "Content-Type": "application/warc-fields"}, block)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, pending = self.where()
        store.create_dir(pending, recursive=True)
        files = RolledFiles(store, pending, self.prefix, self.roll, self.opening())
        first: tuple[bytes, str | None, str | None] | None = None  # digest, id and url of the response of the payload at hand
        last, copy = None, 0
        for batch in iterator:
            for shard, row_id, url, digest, size, payload, hot, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns)):
                copy = copy + 1 if last == (shard, digest, row_id, url) else 0
                last = shard, digest, row_id, url
                if size < self.least:
                    source = None
                elif hot:
                    source = None if copy == 0 and (row_id, url) == (first_id, first_url) else (first_id, first_url)
                elif first and first[0] == digest:
                    source = first[1:]
                else:
                    source, first = None, (digest, row_id, url)
                files.add(shard, self.record(row_id, url, digest, size, payload, source, copy))
        files.close()
        return Written(files.done)

    def record(self, row_id: str | None, url: str | None, digest: bytes, size: int, payload: bytes | None, source: tuple[str | None, str | None] | None, copy: int) -> bytes:
        kind = "revisit" if source else "response"
        name = record_name(kind, row_id, url, digest, copy)
        fields = {
            "WARC-Record-ID": f"<{name}>",
            "WARC-Date": self.date,
            "WARC-Target-URI": uri(url, name),
            "WARC-Payload-Digest": sha1_label(digest),
            "Content-Type": "application/http; msgtype=response",
            "Row-ID": None if row_id is None else quote(row_id, safe=""),
        }
        if source:
            original = record_name("response", *source, digest, 0)
            fields |= {
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "WARC-Refers-To": f"<{original}>",
                "WARC-Refers-To-Target-URI": uri(source[1], original),
                "WARC-Refers-To-Date": self.date,
                "Refers-To-Row-ID": None if source[0] is None else quote(source[0], safe=""),
            }
            return member(kind, fields, http_head(size))
        if payload is None or len(payload) != size or hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"{name} lacks its payload")
        return member(kind, fields, http_head(size) + payload)

    def commit(self, messages: list[Written | None]) -> None:
        """Move the files of the tasks that counted, put the manifest in place, then remove all else, also what dead jobs left."""
        store, folder, pending = self.where()
        files = sorted((x for m in messages if m for x in m.files), key=lambda x: x[1])
        store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: store.move(f"{pending}/{x[0]}", f"{folder}/{x[1]}"), files))
        manifest = {"files": [{"name": name, "bytes": size, "records": n, "sha1": sha} for _, name, size, n, sha in files], "records": sum(x[3] for x in files)}
        store.create_dir(pending, recursive=True)
        with store.open_output_stream(f"{pending}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(manifest, indent=1).encode())
        store.move(f"{pending}/{MANIFEST}", f"{folder}/{MANIFEST}")
        named = {x[1] for x in files}
        for old in store.get_file_info(fs.FileSelector(folder)):
            if old.is_file and old.base_name.endswith(".warc.gz") and old.base_name not in named:
                store.delete_file(old.path)
        store.delete_dir(f"{folder}/{PENDING}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _, pending = self.where()
        if store.get_file_info(pending).type != fs.FileType.NotFound:
            store.delete_dir(pending)


# --- reader ----------------------------------------------------------------------------------------------------------


@dataclass
class Archive(InputPartition):
    name: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as f:
            return [Archive(x["name"], x["bytes"]) for x in json.loads(f.read())["files"]]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, folder = fs.FileSystem.from_uri(self.path)
        at = f"{folder}/{partition.name}"
        if store.get_file_info(at).size != partition.size:
            raise ValueError(f"{at} is not what the manifest says")
        rows: list[tuple[Any, ...]] = []
        held = 0
        with store.open_input_stream(at, compression=None) as raw:
            for fields, block in records(raw):
                if fields["warc-type"] == "warcinfo":
                    continue
                rows.append(self.row(fields, block))
                held += RECORD_BYTES + (len(block) if self.payload else 0)
                if held > BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple[Any, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)

    def row(self, fields: dict[str, str], block: bytes) -> tuple[Any, ...]:
        kind, digest = fields["warc-type"], fields["warc-payload-digest"]
        head, _, payload = block.partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
        size = int(http["content-length"])
        if kind == "response" and (len(payload) != size or sha1_label(hashlib.sha1(payload).digest()) != digest):
            raise ValueError(f"payload of {fields['warc-record-id']} isn't what its headers say")
        plain = lambda x: unquote(fields[x]) if x in fields else None
        return (
            kind, fields["warc-record-id"].strip("<>"), fields["warc-target-uri"], fields["warc-date"], plain("row-id"), fields.get("warc-refers-to", "").strip("<>") or None, plain("refers-to-row-id"),
            digest.removeprefix("sha1:"), size, payload if self.payload and kind == "response" else None,
        )


class WarcSource(DataSource):
    """``format("warc")``: folders that ``write_warc`` wrote."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if not overwrite:
            raise ValueError("a folder of archives is written as a whole: use mode('overwrite')")
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


# --- tables ----------------------------------------------------------------------------------------------------------


def sharded(df: DataFrame, id_col: str, url_col: str, payload_col: str, least_revisit: int, shard_bytes: int) -> DataFrame:
    """Rows in their shards, sorted by digest, id (nulls last) and url, with what the writer must know of frequent payloads."""
    text = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    groups = materialise(rows.groupBy("digest").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min(order).alias("first")))
    held = groups.agg(F.sum("copies"), F.sum(F.col("size") + RECORD_BYTES * F.col("copies")).cast("long")).first()
    n, size = (held[0] or 0), (held[1] or 0)
    shards = max(1, min(MOST_SHARDS, -(-size // shard_bytes)))
    crowd = max(BUCKET_ROWS, n // shards)
    hot = groups.where((F.col("copies") > crowd) & (F.col("size") >= least_revisit)).withColumn("parts", F.ceil(F.col("copies") / crowd).cast("int")).orderBy("digest").collect()  # at most one a shard
    starts, extra = [], 0
    for h in hot:
        starts.append((h.digest, h.first.id, h.first.url, shards + extra, h.parts))
        extra += h.parts
    kind = rows.schema["id"].dataType.simpleString()
    table = df.sparkSession.createDataFrame(starts, f"digest binary, first_id {kind}, first_url string, start int, parts int")
    prefix = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    own = F.floor(prefix * shards / F.lit(2**32)).cast("int")
    part = F.col("start") + F.pmod(F.xxhash64("id", "url"), F.col("parts")).cast("int")
    frequent = F.col("start").isNotNull()
    carried = ~frequent | (F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")))
    placed = rows.join(F.broadcast(table), "digest", "left").select(
        F.coalesce(part, own).alias("shard"), "id", "url", "digest", "size", F.when(carried, F.col("payload")).alias("payload"), frequent.alias("hot"), "first_id", "first_url"
    )
    dealt = placed.repartitionById(shards + extra, "shard").sortWithinPartitions("shard", "digest", F.asc_nulls_last("id"), F.asc_nulls_last("url"))
    return dealt.withColumns({"id": F.col("id").cast("string"), "first_id": F.col("first_id").cast("string")})


def write_warc(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
    prefix: str = "pages", date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write a record per row into gzipped archives in the folder ``path`` (a URI that all executors reach) and replace what was there.

    Of rows with equal payloads of at least ``least_revisit`` bytes the one with the smallest id (ties: smallest url; nulls last) is the
    response and the others are revisits that refer to it; smaller payloads are all responses. Null payloads are
    empty; of rows that are equal in all, one is the response. Null urls get the record's own name as
    target. The same rows give the same files, byte by byte, however they were dealt to tasks. An empty table gives a manifest without
    files. One job at a time writes a folder. A record is held in memory as a whole, nothing larger is. Other columns of ``df`` aren't read.
    """
    df.sparkSession.dataSource.register(WarcSource)
    options = {"path": path, "rollBytes": roll_bytes, "leastRevisit": least_revisit, "prefix": prefix, "date": date}
    sharded(df, id_col, url_col, payload_col, least_revisit, shard_bytes).write.format("warc").options(**options).mode("overwrite").save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder's manifest, one task an archive; every length and digest is verified, a wrong one is an error."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


WARC_SQL = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, array_to_string([lpad(bin(CAST('0x' || c AS INT)), 4, '0') FOR c IN string_split(h, '')], '') AS b FROM hashed),
named AS (SELECT page_id, t, array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST('0b' || b[5 * i + 1 : 5 * i + 5] AS INT)] FOR i IN range(32)], '') AS d FROM bits),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY t) AS first_id FROM named)
SELECT page_id, strlen(t) AS payload_bytes, d AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to
FROM placed
"""
