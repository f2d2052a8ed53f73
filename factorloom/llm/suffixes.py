"""Exact removal of repeated byte strings with suffix arrays.

Whole texts that are equal are counted first, and one of each goes on. A string of ``length`` bytes that starts in two places
of the others is found as follows. The k-grams of every text are
hashed, and each window of ``length`` bytes is assigned to its least (leftmost) k-gram, its anchor; equal
windows have equal anchors in equal places, so they meet at their anchor's hash. Neighbouring windows
with one anchor form a run, whose bytes are its context, named by a cryptographic digest. Contexts of anchors that occur
more than once are dealt to shards by anchor: one run of each context, and a second, to be compared with it, where there are more. Each shard
builds a suffix array of the distinct contexts' bytes by Larsson-Sadakane refinement in numpy and common prefixes by Kasai's pass; a window whose
prefix of ``length`` bytes is its neighbour's is repeated, in this run and in all others with the context.

An anchor with more contexts than a shard holds has several shards, in as many tasks. Windows whose hashes several shards
have are dealt once more, in parts, and each that is alone in its shard is looked up among the sorted windows of the others, by binary search
on their bytes.

Nothing holds all of an anchor: runs of a frequent anchor are counted by context before they are
shuffled, and what is found goes back to the runs by a join that splits frequent contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import join_split, materialise, sized, small_batches

GRAM = 32
#: k-grams of a text whose place fits into 24 bits
LONG = 1 << 24
#: bytes of contexts that one suffix array holds
SHARD_BYTES = 1_500_000
#: an anchor with more runs than this, and than its part of all runs, is frequent; so at most FREQUENT anchors are
ANCHOR_RUNS, FREQUENT = 10_000, 50_000


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a uint64 sequence, from hashes of halves."""
    with np.errstate(over="ignore"):
        step = np.uint64(0x100000001B3)
        have, h, size = [], codes * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0x1234567), 1
        power, rest = step, n
        out, out_size = None, 0
        while rest:
            if rest & 1:  # append this block to what there is
                if out is None:
                    out, out_size = h, size
                else:
                    m = len(codes) - out_size - size + 1
                    out = out[:m] * power + h[out_size : out_size + m]
                    out_size += size
            rest >>= 1
            if rest:
                h = h[:-size] * power + h[size:]
                power, size = power * power, size * 2
        h = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def runs(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of each run of windows with one anchor."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = rolling(np.frombuffer(data, np.uint8).astype(np.uint64), gram)
    span = length - gram + 1
    # the least is that of the greatest 40 bits, the leftmost of equal ones: bits and place in one word, or, of a very long text, in two
    place = np.arange(len(h), dtype=np.uint64)
    if len(h) <= LONG:
        low = h >> np.uint64(24) << np.uint64(24) | place
        at = sliding(low, span, np.minimum) & np.uint64((1 << 24) - 1)
    else:
        low = np.rec.fromarrays([h >> np.uint64(24), place]).view(np.ndarray)
        at = sliding(low, span, lambda x, y: np.where((x["f0"] < y["f0"]) | ((x["f0"] == y["f0"]) & (x["f1"] < y["f1"])), x, y))["f1"]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    found = at[first].astype(np.int64)
    return h[found], found, first, last


def sliding(x: np.ndarray, span: int, least) -> np.ndarray:
    """The least of every ``span`` neighbours, from those of half as many."""
    size, low = 1, x
    while 2 * size <= span:
        low = least(low[:-size], low[size:])
        size *= 2
    return least(low[: len(x) - span + 1], low[span - size : len(x) - size + 1]) if size < span else low


def _order(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Order of pairs of numbers below 2**bits each; packed with their places into one word where they fit, as plain sorting is several times faster."""
    if 3 * bits > 63:
        return np.lexsort((low, high))
    return np.sort(high << 2 * bits | low << bits | np.arange(len(high))) & ((1 << bits) - 1)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement: only groups that are still tied are sorted again, by the ranks that their suffixes have further on, twice as far each time."""
    n = len(codes)
    bits, symbol = (n + 1).bit_length(), int(codes.max(initial=0) + 1).bit_length()
    h = max(1, bits // symbol)
    padded = np.concatenate((codes + 1, np.zeros(2 * h, codes.dtype))).astype(np.int64)  # the end comes before every symbol
    pair = []
    for at in (0, h):
        key = np.zeros(n, np.int64)
        for i in range(at, at + h):
            key = key << symbol | padded[i : i + n]
        pair.append(key)
    sa = _order(*pair, max(bits, symbol * h))
    h, at = 2 * h, np.arange(n)
    high, low = (key[sa] for key in pair)
    rank = np.full(n + 1, -1, np.int64)  # of the empty suffix too
    while True:
        same = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        rank[sa[at]] = at[np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(at)), 0))] if len(at) else at
        at = at[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(at) else at
        if not len(at):
            return sa
        high, low = rank[sa[at]], rank[np.minimum(sa[at] + h, n)] + 1
        order = _order(high, low, bits)
        sa[at] = sa[at][order]
        high, low = high[order], low[order]
        h *= 2


def common_prefixes(codes: np.ndarray, sa: np.ndarray, starts: np.ndarray, sizes: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the suffix sorted before its own (-1: none), and how long a prefix they share; from ``enough`` on, at least so much.

    Kasai's pass over the first ``sizes`` places of every text (from ``starts``) at once: what a place shares is one less than what the place before it
    shared, or more, so each goes on from there, seven symbols at a time.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((codes, np.zeros(enough + 24, codes.dtype))).astype(np.uint64)
    packed = np.zeros(n + enough + 16, np.uint64)
    for i in range(7):
        packed = packed << np.uint64(9) | padded[i : i + len(packed)]
    shared, carried = np.zeros(n, np.int32), np.zeros(len(starts), np.int64)
    order = np.argsort(-sizes, kind="stable")
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)))  # texts that have each place
    for t, m in enumerate(live.tolist()):
        texts = order[:m]
        i = starts[texts] + t
        j = before[i]
        v = np.where(j < 0, 0, np.maximum(carried[texts] - 1, 0))
        active = np.flatnonzero((j >= 0) & (v < enough))
        while len(active):
            x = packed[i[active] + v[active]] ^ packed[j[active] + v[active]]
            more = np.full(len(active), 7)
            differ = np.flatnonzero(x)
            y = x[differ]
            more[differ] = sum(((y >> np.uint64(bits)) == 0).astype(np.int64) for bits in range(9, 63, 9))
            v[active] += more
            active = active[(x == 0) & (v[active] < enough)]
        carried[texts], shared[i] = v, v
    return before, shared


def repeated_windows(contexts: list[bytes], repeated: list[bool], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all contexts laid end to end, whether a window of ``length`` bytes starts at a place that starts anywhere else, in these contexts or in a copy of a ``repeated`` one; and where each context begins."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    codes = np.insert(np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + 1, ends, 0)  # a zero ends each
    starts = ends - sizes + np.arange(len(contexts))
    whole = np.repeat(starts + sizes, sizes + 1) - np.arange(len(codes)) >= length  # within its context
    before, shared = common_prefixes(codes, suffix_array(codes), starts, np.maximum(sizes - length + 1, 0), length)
    equal = (before >= 0) & (shared >= length) & whole
    found = (equal | np.repeat(repeated, sizes + 1)) & whole
    found[before[equal]] = True
    return found, starts


#: what a shard gives: flagged windows first to last of a context, windows that other shards may have (with a part), and the bytes of the contexts that have these
FOUND = pa.schema([("anchor", pa.int64()), ("context", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("part", pa.int32()), ("window", pa.int64()), ("alone", pa.bool_()), ("bytes", pa.binary())])


class Shards:
    """Contexts of whole anchors, or of one shard of an anchor that has several, compared in suffix arrays of bounded size."""

    def __init__(self, length: int, shard_bytes: int = SHARD_BYTES):
        self.length, self.shard_bytes = length, shard_bytes
        self.rows: list[tuple] = []  # (anchor, shard, shards, context, bytes)
        self.repeated: list[bool] = []  # whether another run has the same bytes
        self.bytes = 0

    def add(self, row: tuple) -> pa.RecordBatch | None:
        """Rows (anchor, shard, shards, context, copy, bytes) come in the order of anchor, shard, context and copy.

        Equal contexts are one text of the suffix array, known to be repeated once a second copy's bytes are seen to be the same.
        A first copy that comes again belongs to a repeated row.
        """
        if self.rows and (row[0], row[3]) == (self.rows[-1][0], self.rows[-1][3]):
            if row[5] != self.rows[-1][4]:
                raise RuntimeError("different bytes have one digest")
            self.repeated[-1] = True
            return None
        out = self.flush() if self.bytes >= self.shard_bytes and row[:2] != self.rows[-1][:2] else None
        self.rows.append((*row[:4], row[5]))
        self.repeated.append(False)
        self.bytes += len(row[5])
        return out

    def flush(self) -> pa.RecordBatch | None:
        """Flagged windows of each context, and the windows that other shards of an anchor may have, each once a shard, with their contexts' bytes, so that no text is looked up again."""
        rows, repeated, self.rows, self.repeated, self.bytes = self.rows, self.repeated, [], [], 0
        if not rows:
            return None
        flags, starts = repeated_windows([r[4] for r in rows], repeated, self.length)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))  # contexts end in places without windows
        of = np.searchsorted(starts, edge[::2], "right") - 1
        out, contexts = [(of, edge[::2] - starts[of], edge[1::2] - starts[of], None)], []
        for _, group in groupby((i for i, r in enumerate(rows) if r[2] > 1), key=lambda i: rows[i][:2]):
            here = list(group)
            hashes = [rolling(np.frombuffer(rows[i][4], np.uint8).astype(np.uint64), self.length) for i in here]
            sizes = [len(h) for h in hashes]
            at, of = np.concatenate([np.arange(n) for n in sizes]), np.repeat(here, sizes)
            windows, once = np.unique(np.concatenate(hashes).view(np.int64), return_index=True)
            at, of = at[once], of[once]
            out.append((of, at, at + 1, (windows % rows[here[0]][2], windows, ~flags[starts[of] + at])))
            contexts += here
        tables = []
        for of, first, last, more in out:
            cells = more or ([None] * len(of),) * 3
            tables.append([[rows[i][0] for i in of.tolist()], [rows[i][3] for i in of.tolist()], first, last, *cells, [None] * len(of)])
        none = [None] * len(contexts)
        tables.append([[rows[i][0] for i in contexts], [rows[i][3] for i in contexts], none, none, none, none, none, [rows[i][4] for i in contexts]])
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(t[k], kind) for t in tables]) for k, kind in enumerate(FOUND.types)], schema=FOUND)


def merge_shards(table: pa.Table, length: int) -> pa.Table:
    """Of one anchor's windows in one part, those that are alone in their shard and found in another: binary search among all, sorted by their bytes."""
    windows = np.frombuffer(b"".join(table["bytes"].to_pylist()), f"S{length}")
    ordered = np.sort(windows)  # a shard gives a window once
    times = np.searchsorted(ordered, windows, "right") - np.searchsorted(ordered, windows, "left")
    return table.filter(pa.array(table["alone"].to_numpy(zero_copy_only=False) & (times > 1))).select(["anchor", "context", "first", "last"])


def find_runs(df: DataFrame, length: int) -> DataFrame:
    """(anchor, context, doc_id, h, start, windows, times) of every run of every text; df has doc_id, h and text.

    Neighbouring runs with equal contexts, as in periodic text, are one row with the number of ``times``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.blake2b
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                hashes, _, first, last = runs(data, length)
                if not len(hashes):
                    continue
                context = [digest(data[a : b + length], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist())]
                again = [i for i in (np.flatnonzero(hashes[1:] == hashes[:-1]) + 1).tolist() if context[i] == context[i - 1]]
                heads = np.delete(np.arange(len(context)), again).tolist()
                out[0] += hashes[heads].view(np.int64).tolist()
                out[1] += [context[i] for i in heads]
                out[2] += [doc] * len(heads)
                out[3] += [h] * len(heads)
                out[4] += first[heads].tolist()
                out[5] += (last - first + 1)[heads].tolist()
                out[6] += np.diff([*heads, len(hashes)]).tolist()
            types = [pa.int64(), pa.binary(), batch.schema.types[0], pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["anchor", "context", "doc_id", "h", "start", "windows", "times"])

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "h", "text").mapInArrow(run, f"anchor long, context binary, doc_id {kind}, h long, start int, windows int, times int")


RUN = ["doc_id", "h", "start", "windows"]


def meet(found: DataFrame, shard_contexts: int, anchor_runs: int) -> tuple[DataFrame, DataFrame]:
    """Runs whose anchor occurs more than once, and what is compared: (anchor, context, copy, shard, shards, run), a run of each of their contexts and a second of those that have more.

    Frequent anchors are told from counts; there are at most FREQUENT, so their table is broadcast. Runs of all other anchors meet
    at their anchor. Runs of frequent ones are counted by context, which collapses them before the shuffle.
    """
    limit = max(anchor_runs, found.count() // FREQUENT)
    frequent = F.broadcast(materialise(found.groupBy("anchor").count().where(F.col("count") > limit).select("anchor")))
    dealt = F.ceil(F.col("contexts") / shard_contexts).cast("int").alias("shards")
    run = F.struct(*RUN)
    again = F.struct("doc_id", "h", (F.col("start") + F.col("windows")).alias("start"), "windows")  # the second time in a row

    by_anchor, by_context = Window.partitionBy("anchor"), Window.partitionBy("anchor", "context")
    met = found.join(frequent, "anchor", "left_anti").repartition("anchor").withColumn("all", F.sum("times").over(by_anchor)).where("all > 1")
    met = met.withColumn("n", F.sum("times").over(by_context)).withColumn("rows", F.count("*").over(by_context)).withColumn("place", F.row_number().over(by_context.orderBy(*RUN)))
    met = met.withColumn("contexts", F.count(F.when(F.col("place") == 1, 1)).over(by_anchor))
    met = materialise(met.select("anchor", "context", *RUN, "times", "n", "rows", "place", dealt))
    one = met.where("place = 1").select("anchor", "context", "shards", F.lit(1).alias("copy"), *RUN)
    two = met.where("n > 1 and place = least(2, rows)").select("anchor", "context", "shards", F.lit(2).alias("copy"), F.when(F.col("rows") == 1, again).otherwise(run).alias("run")).select("anchor", "context", "shards", "copy", "run.*")

    hot = found.join(frequent, "anchor", "left_semi")
    counted = materialise(hot.groupBy("anchor", "context").agg(F.sum("times").alias("n"), F.count("*").alias("rows"), F.min(run).alias("run"), F.max(F.when(F.col("times") > 1, again).otherwise(run)).alias("other")))
    contexts = F.broadcast(counted.groupBy("anchor").agg(F.count("*").alias("contexts")).select("anchor", dealt))
    hot_one = counted.join(contexts, "anchor").select("anchor", "context", "shards", F.lit(1).alias("copy"), "run.*")
    hot_two = counted.where("n > 1").join(contexts, "anchor").select("anchor", "context", "shards", F.lit(2).alias("copy"), "other.*")

    asked = one.union(two).union(hot_one).union(hot_two).withColumn("shard", F.pmod(F.xxhash64("context"), F.col("shards").cast("long")).cast("int"))
    cells = ["anchor", "context", *RUN, "times"]
    return met.select(cells).union(hot.select(cells)), asked


def remove_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, anchor_runs: int = ANCHOR_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) for every row.

    Removed is every byte that lies in a string of ``length`` bytes which also starts anywhere else, in the same
    text or another; strings are judged on the input. Null texts count as empty, texts shorter
    than ``length`` lose nothing; repeated rows repeat each other; null ids are ordinary values; an empty
    table gives an empty result; other columns are not read. ``kept`` may end inside a character, so it is binary.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = dict(df.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))

    # whole texts that are equal: all of a long one goes, and the rows with the least id stand for them
    keyed = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("key"), F.octet_length(text).alias("b")).where(F.col("b") >= length)
    copies = materialise(keyed.groupBy("key", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1"))
    copies = sized(copies)
    whole = keyed.join(copies.select("key", "b"), ["key", "b"]).select("doc_id", "h", F.lit(0).alias("a"), "b")
    once = docs.where(F.octet_length("text") >= length).withColumn("key", F.unhex(F.sha2("text", 256))).join(copies.select("key", "least", "n"), "key", "left").where(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("least")))

    runs_, asked = meet(materialise(find_runs(once, length)), max(1, shard_bytes // (2 * length)), anchor_runs)

    # bytes of the runs that are compared
    fields = [("anchor", pa.int64()), ("shard", pa.int32()), ("shards", pa.int32()), ("context", pa.binary()), ("copy", pa.int32()), ("bytes", pa.binary())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).flatten()
            owner = np.repeat(np.arange(batch.num_rows), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            data = [t.encode() for t in batch.column(1).to_pylist()]
            start, windows = (cells.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows"))
            pieces = [data[d][a:b] for d, a, b in zip(owner.tolist(), start.tolist(), (start + windows + length - 1).tolist())]
            yield pa.RecordBatch.from_arrays([*(cells.field(c) for c, _ in fields[:-1]), pa.array(pieces, pa.binary())], names=[c for c, _ in fields])

    def bytes_of(chosen: DataFrame) -> DataFrame:
        listed = chosen.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "shard", "shards", "context", "copy", "start", "windows")).alias("runs"))
        texts = listed.join(docs, listed["doc_id"].eqNullSafe(docs["doc_id"]) & (listed["h"] == docs["h"])).select("runs", "text")
        return texts.mapInArrow(cut, "anchor long, shard int, shards int, context binary, copy int, bytes binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(length, shard_bytes)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out = shards.add(row)
                if out is not None:
                    yield out
        out = shards.flush()
        if out is not None:
            yield out

    dealt = bytes_of(asked).repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "context", "copy")
    compared = materialise(dealt.mapInArrow(compare, "anchor long, context binary, first int, last int, part int, window long, alone boolean, bytes binary"))
    marks = compared.where("part is null and bytes is null").select("anchor", "context", "first", "last")

    # windows that several shards of an anchor may have
    by_window = Window.partitionBy("anchor", "window")
    shared = compared.where("part is not null").withColumn("times", F.count("*").over(by_window)).withColumn("any", F.bool_or("alone").over(by_window)).where("times > 1 and any")
    shared = materialise(shared.select("anchor", "context", "first", "last", "part", "alone"))
    if not shared.isEmpty():
        needed = compared.where("bytes is not null").select("anchor", "context", "bytes")
        pieces = shared.join(needed, ["anchor", "context"]).withColumn("bytes", F.substring("bytes", F.col("first") + 1, F.lit(length)))
        marks = marks.union(pieces.groupBy("anchor", "part").applyInArrow(lambda t: merge_shards(t, length), "anchor long, context binary, first int, last int"))

    found = join_split(runs_, marks.groupBy("anchor", "context").agg(F.collect_set(F.struct("first", "last")).alias("marks")), ["anchor", "context"])
    # a context that comes several times in a row is flagged as a whole
    each = F.explode(F.when(F.col("times") > 1, F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") * F.col("times")).alias("last")))).otherwise(F.col("marks"))).alias("m")
    ranges = found.select("doc_id", "h", "start", each).select("doc_id", "h", (F.col("start") + F.col("m.first")).alias("a"), (F.col("start") + F.col("m.last") + (length - 1)).alias("b"))
    covered = ranges.union(whole).groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    covered = materialise(covered).withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    marked = docs.join(covered, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["h"] == F.col("_h")), "left").select("doc_id", "text", "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text_, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, pieces, end, n_spans = text_.encode(), [], 0, 0
                for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if a > end or not n_spans:
                        pieces.append(data[end:a])
                        n_spans += 1
                    end = max(end, b)
                kept = b"".join([*pieces, data[end:]])
                for into, x in zip(out, (len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                    into.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
