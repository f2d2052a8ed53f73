"""SimHash near-duplicates found through pivot distance tables.

Every fingerprint has a table of Hamming distances to reference fingerprints. A flipped bit changes a
distance by one, so fingerprints that differ in at most two bits differ by at most two in every distance; and
two flips touch at most two of five blocks of bits, so the distances taken over the other blocks are
equal. Equal distances over three blocks are therefore the key under which fingerprints meet: no link is
lost. Where they meet, pairs are discarded by their largest difference in any distance, and the
survivors are verified by exact Hamming distance. A meeting of many fingerprints gives a spanning forest
of links, not its pairs; beyond ``crowd`` members it is linked through one-bit neighbours instead, in time
and memory that grow with the number of members only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import components, join_split, materialise, row_key, sized, small_batches
from factorloom.llm.hashing import majority_bits, shingle_hashes

#: first bit and width of each block
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
REFERENCES = 6
BITS = 2


def _references() -> np.ndarray:
    return np.random.default_rng(20_240_601).integers(0, 2**64, REFERENCES, dtype=np.uint64)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _mask(block: tuple[int, int]) -> int:
    return ((1 << block[1]) - 1) << block[0]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = majority_bits([h for (h,) in shingle_hashes(batch.column(1).to_pylist(), shingle)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"doc_id {kind}, fp long")


def distance_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): for every three blocks, a hash of all distances to the references over them."""
    refs = [_signed(int(r)) for r in _references()]
    masks = [_signed(_mask(b)) for b in BLOCKS]
    table = fps.select("fp", *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r)).bitwiseAND(F.lit(m))).alias(f"d{b}_{j}") for b, m in enumerate(masks) for j, r in enumerate(refs)])
    keys = [F.xxhash64(F.lit(i), *[f"d{b}_{j}" for b in chosen for j in range(REFERENCES)]) for i, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - BITS))]
    return table.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of at most BITS differing bits that join all that such links join, one fewer than members at most."""
    masks = np.array([_mask(b) for b in BLOCKS], np.uint64)
    table = np.bitwise_count((fps[:, None, None] ^ _references()[None, :, None]) & masks).reshape(len(fps), -1).astype(np.int8)
    links, open_ = [], np.arange(len(fps))
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            near = open_[np.abs(table[open_] - table[x]).max(axis=1) <= BITS]
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= BITS]
            if len(near):
                links += [(int(x), int(y)) for y in near]
                queue += near.tolist()
                open_ = np.setdiff1d(open_, near, assume_unique=True)
    return links


def near_links(fps: DataFrame, crowd: int = 8_192) -> DataFrame:
    """(a, b) of distinct fingerprints (column fp): links of at most two differing bits with the same components as all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

        def linked(members: list[np.ndarray]) -> pa.RecordBatch:
            every = np.concatenate(members)
            found = np.array(forest(every), np.int64).reshape(-1, 2)
            return table(every.view(np.int64)[found[:, 0]], every.view(np.int64)[found[:, 1]], False)

        key, held, full = None, [], False  # of a crowded key no more than a crowd is held at once
        for batch in batches:
            keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if e - s == 1 and 0 < s and e < len(keys):
                    continue  # alone
                if keys[s] != key:
                    if not full and sum(map(len, held)) > 1:
                        yield linked(held)
                    key, held, full = keys[s], [], False
                held.append(values[s:e])
                if full or sum(map(len, held)) > crowd:
                    members = np.concatenate(held).view(np.int64)
                    yield table(members, members, True)
                    held, full = [], True
        if not full and sum(map(len, held)) > 1:
            yield linked(held)

    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # rows of two numbers
    dealt = distance_keys(fps).repartition("key").sortWithinPartitions("key", "fp")
    links = materialise(dealt.mapInArrow(run, "a long, b long, crowded boolean"))
    direct = links.where("not crowded").select("a", "b")
    crowded = links.where("crowded").select(F.col("a").alias("fp")).distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    ways = crowded.select("fp", F.explode(around).alias("way"))
    hubs = ways.groupBy("way").agg(F.min("fp").alias("hub"))
    return direct.unionByName(ways.join(hubs, "way").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable by links) for every row.

    Fingerprints link at two or fewer differing bits. Null and empty texts have fingerprint zero and are
    linked like any other; texts of fewer words than a shingle give one shingle; repeated rows stay; null
    ids are never the smallest, and a group of them alone has a null component; an empty table gives an
    empty result; other columns are not read. Equal fingerprints meet once, whatever their number.
    """
    rows = materialise(fingerprints(df, id_col, text_col, shingle))
    unique = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(near_links(unique.select("fp")))
    placed = unique.join(groups, unique["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(roots, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: longs of a sketch of a set of shingles: parities of 64 buckets each
SKETCH = 8
#: texts whose shingles say which are frequent; shingles of so many of them are, and as many of these are told apart
SAMPLE_TEXTS, FREQUENT, MOST_FREQUENT = 5_000, 3, 100_000
#: members of one shingle that are compared in one block
BLOCK = 4_096
#: counts that are compared at once
COMPARED = 4 << 20


def parities(distinct: np.ndarray) -> np.ndarray:
    """Whether each of 512 hash buckets holds an odd number of the set: two sets' parities differ in as many buckets as the sets in shingles, at most."""
    odd = np.bincount((distinct >> np.uint64(55)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: sets of so many shingles have counts too: in larger ones the parities of unlike sets differ no more than those of like sets may
COUNTED = 768


def counted(distinct: np.ndarray) -> bytes | None:
    """How many of a large set are in each of its hash buckets, some eight to sixteen on average: two sets' counts differ in sum by as much as the sets in shingles, at most."""
    if len(distinct) < COUNTED:
        return None
    bits = min(len(distinct).bit_length() - 4, 10)  # a kilobyte at most, as every key carries it: of very large sets the bound is weaker
    return np.minimum(np.bincount((distinct >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def laid_out(counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts end to end, where each set's begin and how many it has."""
    lengths = pc.fill_null(pc.binary_length(counts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(c for c in counts.to_pylist() if c), np.uint8), np.cumsum(lengths) - lengths, lengths


def counts_apart(laid: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much the counts of sets x and y differ, the finer ones added up to the others' buckets; 0 if one has none."""
    data, starts, lengths = laid
    out = np.zeros(len(x), np.int64)
    both = np.flatnonzero((lengths[x] > 0) & (lengths[y] > 0))
    kinds, kind = np.unique(lengths[x[both]] << 32 | lengths[y[both]], return_inverse=True)
    for k, joint in enumerate(kinds.tolist()):
        wide, least = (joint >> 32, joint & 0xFFFFFFFF), min(joint >> 32, joint & 0xFFFFFFFF)
        members = both[kind == k]
        for part in np.array_split(members, -(-len(members) * max(wide) // COMPARED)):
            a, b = (np.minimum(data[starts[z[part]][:, None] + np.arange(w)].reshape(len(part), least, -1).sum(axis=2, dtype=np.int32), 255) for z, w in zip((x, y), wide))
            out[part] = np.abs(a - b).sum(axis=1)
    return out


def text_number(hashes: np.ndarray) -> int:
    """A number for texts of equal shingles, repeats included."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(np.sort(hashes).tobytes(), 7))


def described(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, row_key, fp3, same, n, sketch, counts, sample): the contract's fingerprint, ``text_number``, distinct shingles, their parities and counts; the shingles themselves of some texts."""
    small_batches(df.sparkSession)
    one_in = max(1, df.count() // SAMPLE_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, out = [], [[], [], [], [], []]
            for three, h in shingle_hashes(batch.column(2).to_pylist(), 3, shingle):
                short.append(three)
                same, distinct = text_number(h), np.unique(h)
                sample = distinct.view(np.int64) if same % one_in == 0 else None
                for into, x in zip(out, (same, len(distinct), parities(distinct), counted(distinct), sample)):
                    into.append(x)
            out.insert(0, majority_bits(short).view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip(out, kinds))], names=["doc_id", "row_key", "fp3", "same", "n", "sketch", "counts", "sample"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_key string, fp3 long, same long, n int, sketch array<long>, counts binary, sample array<long>")


def frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the sampled texts have, sorted, and their numbers of texts. They only order the shingles: any table gives the same links."""
    sampled = rows.where("sample is not null").groupBy("same").agg(F.first("sample").alias("sample"))
    counts = sampled.select(F.explode("sample").alias("h")).groupBy("h").agg(F.count("*").cast("int").alias("c")).where(F.col("c") >= FREQUENT)
    found = counts.orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def rarest(distinct: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The prefix of a sorted set, rare shingles first: one shingle more than a set of at least this similarity can lack, so that two such sets' prefixes meet."""
    known, counts = frequent
    rank = np.zeros(len(distinct), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        rank = np.where(known[at] == distinct, counts[at], 0)
    n = len(distinct)
    return distinct[np.argsort(rank, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def shared_prefixes(rows: DataFrame, df: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(key, same) for every shingle that is in the prefixes of several texts."""
    frequent = df.sparkSession.sparkContext.broadcast(frequent_shingles(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sames = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for (h,) in shingle_hashes(batch.column(0).to_pylist(), shingle):
                same = text_number(h)
                if not len(h) or same in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(same)
                keys.append(rarest(np.unique(h), frequent.value, similarity))
                sames.append(np.full(len(keys[-1]), same))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sames))], names=["key", "same"])

    small_batches(df.sparkSession)
    dealt = df.select(F.col(text_col).alias("_text")).mapInArrow(run, "key long, same long").repartition("key")
    every = Window.partitionBy("key")
    return dealt.withColumn("first", F.min("same").over(every)).withColumn("last", F.max("same").over(every)).where("first < last").select("key", "same").distinct()


def most_apart(both: np.ndarray | Column, similarity: float) -> np.ndarray | Column:
    """Shingles in which two sets that have so many together differ at most, if they have the similarity."""
    return both * ((1 - similarity) / (1 + similarity)) + 1e-6


def alike(similarity: float) -> Column:
    """Whether the sizes and parities of a and b (n_a, n_b, s_a, s_b) allow the similarity; never false if they have it."""
    apart = sum((F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(SKETCH)), F.lit(0))
    return (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6) & (apart <= most_apart(F.col("n_a") + F.col("n_b"), similarity))


def centre_pairs(shared: DataFrame, unique: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text with the centre of each of its keys, the member that has most shared keys; as many pairs as keys at most."""
    ranked = shared.join(shared.groupBy("same").count(), "same")
    centres = ranked.groupBy("key").agg(F.max(F.struct("count", "same")).alias("c")).select("key", F.col("c.same").alias("b"))
    pairs = shared.join(centres, "key").where("same <> b").select(F.least("same", "b").alias("a"), F.greatest("same", "b").alias("b")).distinct()
    side = lambda x: unique.select(F.col("same").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(alike(similarity)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"))
    large = lambda x: unique.where("counts is not null").select(F.col("same").alias(x), F.col("counts").alias(f"c_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(len(batch))
            apart = counts_apart(laid_out(pa.concat_arrays([batch.column(3), batch.column(4)])), at, at + len(batch))
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most_apart(batch.column(2).to_numpy(), similarity)))

    return near.join(large("a"), "a", "left").join(large("b"), "b", "left").select("a", "b", "both", "c_a", "c_b").mapInArrow(run, "a long, b long")


#: pairs that are compared at once
PAIRS = 500_000


def block_pairs(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, own: np.ndarray, same: np.ndarray, component: np.ndarray, n: np.ndarray, sketch: np.ndarray, similarity: float, counts: pa.Array | None = None) -> Iterator[np.ndarray]:
    """Pairs of unequal components that sizes, parities and counts allow, as rows (a, b, least) with a < b, over groups of members laid end to end.

    Group g has ``sizes[g]`` members; those of block i[g] meet those of block j[g]. ``least`` is how many keys such a pair must
    share: beyond the prefix that ends first, its text has ceil(similarity * n) - 1 shingles only.
    """
    group = np.repeat(np.arange(len(sizes)), sizes)
    left, right = np.flatnonzero(own == i[group]), np.flatnonzero(own == j[group])
    begin, end = np.searchsorted(group[right], np.arange(len(sizes))), np.searchsorted(group[right], np.arange(len(sizes)), "right")
    met = (end - begin)[group[left]]
    laid = None if counts is None else laid_out(counts)
    pieces = np.flatnonzero(np.diff(np.cumsum(met) // PAIRS, prepend=0))
    for part in np.split(np.arange(len(left)), pieces):
        x = np.repeat(left[part], met[part])
        y = right[np.arange(len(x)) - np.repeat(np.cumsum(met[part]) - met[part], met[part]) + np.repeat(begin[group[left[part]]], met[part])]
        ok = (component[x] != component[y]) & ((own[x] != own[y]) | (same[x] < same[y]))
        ok &= np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6
        x, y = x[ok], y[ok]
        apart = np.zeros(len(x), np.int64)
        for word in sketch.view(np.uint64).T:  # bitwise_count takes the absolute value of signed numbers
            apart += np.bitwise_count(word[x] ^ word[y])
        near = apart <= most_apart(n[x] + n[y], similarity)
        x, y = x[near], y[near]
        if laid is not None:
            near = counts_apart(laid, x, y) <= most_apart(n[x] + n[y], similarity)
            x, y = x[near], y[near]
        least = np.ceil((n[x] + n[y]) * (similarity / (1 + similarity)) - 1e-6) - np.ceil(similarity * np.maximum(n[x], n[y]) - 1e-9) + 1
        yield np.stack([np.minimum(same[x], same[y]), np.maximum(same[x], same[y]), least.astype(np.int64)], axis=1)


#: rows of pairs that a task adds up before it passes them on
HELD = 200_000


def added_up(found: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, least, k), one for each (a, b, least) with the sum of k."""
    rows = np.concatenate([np.zeros((0, 4), np.int64), *found])
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows[:, 2::-1].T)]
    first = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
    return np.column_stack([rows[first, :3], np.add.reduceat(rows[:, 3], first)])


def met_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b, least, k) over groups of members (i, j, members): ``block_pairs`` with the number of groups in which they met, added up over many batches."""
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["a", "b", "least", "k"])
    held: list[np.ndarray] = []
    for batch in batches:
        lists = batch.column(2)
        own, same, component, n = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
        sketch, counts = lists.flatten().field(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH), lists.flatten().field(5)
        i, j, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
        for pairs in block_pairs(i, j, sizes, own, same, component, n, sketch, similarity, counts):
            held.append(added_up([np.column_stack([pairs, np.ones(len(pairs), np.int64)])]))
            if sum(map(len, held)) > HELD:
                held = [added_up(held)]
                if len(held[0]) > HELD // 2:
                    yield table(held.pop())
    if held:
        yield table(added_up(held))


def open_pairs(shared: DataFrame, unique: DataFrame, groups: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs that share enough keys, are in different groups so far, and may have the similarity.

    The members of a key are dealt to blocks and every two blocks meet in a task of their own, so a frequent key is no single task.
    """
    placed = unique.join(groups, unique["same"] == groups["node"], "left").select("same", F.coalesce("component", "same").alias("component"), "n", "sketch", "counts")
    joined = materialise(shared.join(placed.select("same", "component"), "same"))
    open_ = joined.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    parted = join_split(joined.select("key", "same"), open_.select("key", F.ceil(F.col("members") / F.lit(block)).cast("int").alias("blocks")), ["key"])
    parted = materialise(parted.select("key", "same", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int").alias("own"), "blocks"))
    dealt = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(placed, "same")
    met = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("own", "same", "component", "n", "sketch", "counts")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return met_pairs(batches, similarity)

    small_batches(shared.sparkSession)
    return met.select("i", "j", "members").mapInArrow(run, "a long, b long, least long, k long").groupBy("a", "b", "least").agg(F.sum("k").alias("k")).where("k >= least").select("a", "b")


def verified(pairs: DataFrame, unique: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact sets of shingles have the similarity."""
    near = materialise(pairs)
    asked = near.select(F.explode(F.array("a", "b")).alias("same")).distinct().join(unique.select("same", F.col("row_key").alias("key")), "same")
    asked = sized(materialise(asked), F.length("key"))
    texts = df.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("_text")).join(asked, "key").select("same", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(h).view(np.int64) for (h,) in shingle_hashes(batch.column(1).to_pylist(), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["same", "h"])

    small_batches(df.sparkSession)
    hashed = materialise(texts.mapInArrow(sets, "same long, h array<long>").groupBy("same").agg(F.first("h").alias("h")))
    both = near.join(hashed.withColumnsRenamed({"same": "a", "h": "ha"}), "a").join(hashed.withColumnsRenamed({"same": "b", "h": "hb"}), "b")
    met = F.size(F.array_intersect("ha", "hb"))
    return materialise(both.where(met >= similarity * (F.size("ha") + F.size("hb") - met)).select("a", "b"))


def similar_groups(rows: DataFrame, links: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of ``same`` numbers: groups by ``links`` and by all pairs of texts whose word shingles have at least this similarity.

    Such pairs share one of their rarest shingles (``rarest``). First every text is compared with the centres of its
    keys, which joins most groups in few pairs; then all pairs that share a key and are still in different
    groups are compared, whatever their number. Pairs are discarded only by bounds that hold always.
    """
    unique = materialise(rows.where("n > 0").groupBy("same").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("counts").alias("counts"), F.min("row_key").alias("row_key")))
    shared = materialise(shared_prefixes(rows, df, text_col, shingle, similarity))
    how = (unique, df, id_col, text_col, shingle, similarity)
    groups = materialise(components(links.unionByName(verified(centre_pairs(shared, unique, similarity), *how))))
    more = verified(open_pairs(shared, unique, groups, similarity), *how)
    if more.isEmpty():
        return groups
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df``, one for each group: that with the least id, then the least text hash; null ids last.

    Texts are linked if their contract fingerprints (three words) differ in two bits at most, or if their
    ``shingle``-word shingles have at least ``similarity``; groups are the components of both. Texts of equal shingles are one
    node, whatever their number. Null, empty and short texts are as in ``simhash_groups``.
    """
    rows = materialise(described(df, id_col, text_col, shingle))
    heads = materialise(rows.groupBy("fp3").agg(F.min("same").alias("head")))
    inside = rows.join(heads, "fp3").select(F.col("same").alias("a"), F.col("head").alias("b")).where("a <> b").distinct()
    between = near_links(heads.select(F.col("fp3").alias("fp"))).withColumnsRenamed({"a": "x", "b": "y"})
    between = between.join(heads.withColumnsRenamed({"fp3": "x", "head": "a"}), "x").join(heads.withColumnsRenamed({"fp3": "y", "head": "b"}), "y").select("a", "b")
    groups = similar_groups(rows, inside.unionByName(between), df, id_col, text_col, shingle, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("m")
    each = rows.groupBy("same").agg(first)  # copies meet once
    named = each.join(groups, each["same"] == groups["node"], "left").select(F.coalesce("component", "same").alias("root"), "m")
    best = named.groupBy("root").agg(F.min("m").alias("m")).select(F.col("m.row_key").alias("_key"))
    keyed = df.select(F.struct(*df.columns).alias("_row"), row_key(F.col(id_col), F.col(text_col)).alias("_key"))
    return keyed.join(best, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).select("_row.*")
