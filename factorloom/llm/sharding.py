"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked: every group of copies is one hyperedge, never expanded into
pairs. All documents start in the shard that their hash names. Copies of one group are interchangeable, so the state that the iterations move is
(group, shard, rows): what a document must know of its neighbours, in ``n_shards`` rows for a group of any size.
In each round every group takes the shards with most of its rows as its homes, as few as hold it, and its other rows ask to move there. Shards
admit under quotas: what comes may exceed what leaves by the room that a shard has, so full shards still exchange rows. Which rows of
those that ask for one way go is chance, new in each round. Groups that have come together rest; rounds go on until the others' parts stop
getting fewer. Then counts are evened out: groups still apart, and those beyond a quota, fill what room the others leave, one after the
other, and rows without links take the rest, so all counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import buckets_for, join_split, materialise, running_total

#: shards up to which exchanges of three are looked for, and rounds without progress after which propagation ends
THREE_WAYS, PATIENCE = 64, 2


def wishes(state: DataFrame, quota: list[int], salt: int) -> DataFrame:
    """(g, shard, to, k, luck): how many rows each group wants to move from a shard that isn't its home to one that is."""
    group = Window.partitionBy("g")
    order = group.orderBy(F.desc("c"), F.xxhash64("g", "shard", F.lit(salt)), "shard")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    rows = state.withColumn("q", F.array(*[F.lit(q) for q in quota])[F.col("shard")].cast("long")).withColumn("all", F.sum("c").over(group)).withColumn("held", total("q"))
    rows = rows.withColumn("home", F.col("held") < F.col("all"))
    rows = rows.withColumn("r", F.when(F.col("home"), F.greatest(F.lit(0), F.least("q", F.col("all") - F.col("held")) - F.col("c"))))
    rows = rows.withColumn("free", total("r")).withColumn("at", total(F.when(~F.col("home"), F.col("c"))))
    homes = F.collect_list(F.when(F.col("home"), F.struct("free", "r", F.col("shard").alias("to")))).over(group)  # n_shards at most
    moving = rows.withColumn("homes", homes).where("not home").select("g", "shard", "c", "at", F.explode("homes").alias("h"))
    k = F.least(F.col("h.free") + F.col("h.r"), F.col("at") + F.col("c")) - F.greatest("h.free", "at")
    return moving.select("g", "shard", "h.to", k.alias("k"), F.xxhash64("g", F.lit(salt)).alias("luck")).where("k > 0")


def admitted(asks: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go each way (from, to): at most those that ask, and into no shard more than leave it and it has room for.

    Starts from all that ask, cuts what shards can't take until all can, then adds what still fits: single moves, exchanges of two
    shards and of three.
    """
    n, x = len(room), dict(asks)
    room = [max(0, r) for r in room]
    into, out = [0] * n, [0] * n

    def move(s: int, t: int, k: int) -> None:
        x[s, t] = x.get((s, t), 0) + k
        into[t] += k
        out[s] += k

    for (s, t), k in asks.items():
        into[t] += k
        out[s] += k
    while over := [t for t in range(n) if into[t] - out[t] > room[t]]:
        t = over[0]
        keep, had = max(0, room[t] + out[t]), into[t]
        for s in range(n):
            if k := x.get((s, t), 0):
                move(s, t, k * keep // had - k)
    left = {k: v - x[k] for k, v in asks.items() if v > x[k]}
    more = True
    while more:
        more = False
        for s, t in list(left):
            back = range(n) if n <= THREE_WAYS else ()
            ways = [((s, t),), ((s, t), (t, s)), *(((s, t), (t, u), (u, s)) for u in back if (t, u) in left and (u, s) in left)]
            for way in ways:
                k = min(left.get(w, 0) for w in way)
                if len(way) == 1:
                    k = min(k, room[t] - into[t] + out[t])
                if k > 0:
                    more = True
                    for w in way:
                        move(*w, k)
                        left[w] -= k
    return x


def propagate(state: DataFrame, quota: list[int], rounds: int, buckets: int) -> DataFrame:
    """Move (g, shard, c) towards each group's homes; (g, shard, c, parts) of all groups when no more come together."""

    def measured(df: DataFrame) -> DataFrame:
        return materialise(df.withColumn("parts", F.count("*").over(Window.partitionBy("g"))))

    resting: list[DataFrame] = []
    load, least, stale = [0] * len(quota), None, 0
    active = measured(state)
    for salt in range(rounds):
        sums = active.groupBy("shard").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("parts") == 1, F.col("c"))).alias("done"), F.count_if(F.col("parts") > 1).alias("open")).collect()  # n_shards rows
        now = list(load)
        for r in sums:
            now[r["shard"]] += r["c"]
            load[r["shard"]] += r["done"] or 0
        resting.append(active.where("parts = 1"))
        active, parts = active.where("parts > 1"), sum(r["open"] for r in sums)
        least, stale = (parts, 0) if least is None or parts < least else (least, stale + 1)
        if not parts or stale >= PATIENCE:
            break
        asked = materialise(wishes(active, quota, salt))
        asks = {(r["shard"], r["to"]): int(r["k"]) for r in asked.groupBy("shard", "to").agg(F.sum("k").alias("k")).collect()}  # n_shards squared at most
        going = {k: v for k, v in admitted(asks, [q - c for q, c in zip(quota, now)]).items() if v}
        if not going:
            stale = PATIENCE if not asks else stale
            active = measured(active.drop("parts"))
            continue
        limit = F.create_map(*[F.lit(v) for (s, t), k in going.items() for v in (s * len(quota) + t, k)])
        told = running_total(asked, ["shard", "to"], ["luck", "g"], "k", "before", buckets)
        allowed = F.coalesce(F.try_element_at(limit, F.col("shard") * len(quota) + F.col("to")), F.lit(0))
        moved = told.withColumn("k", F.least(F.col("k"), allowed - F.col("before"))).where("k > 0")
        change = moved.select("g", "shard", (-F.col("k")).alias("c")).union(moved.select("g", "to", "k"))
        active = measured(active.drop("parts").union(change).groupBy("g", "shard").agg(F.sum("c").alias("c")).where("c > 0"))
    return reduce(DataFrame.union, [*resting, active])


def even_out(state: DataFrame, quota: list[int], buckets: int) -> tuple[DataFrame, list[int]]:
    """(g, shard, c) within the quotas, and the rows that each shard then holds.

    Groups that are in one shard stay as far as its quota goes, in a hashed order. The others are laid one after the other over the room
    that is left, the largest rooms first, and cut only where a shard is full.
    """
    whole = running_total(state.where("parts = 1"), ["shard"], ["g"], "c", "before", buckets)
    limits = F.array(*[F.lit(q) for q in quota])
    fits = (F.col("before") + F.col("c") <= limits[F.col("shard")]).alias("fits")
    judged = materialise(whole.select("g", "shard", "c", fits).union(state.where("parts > 1").select("g", "shard", "c", F.lit(False))))
    held = [0] * len(quota)
    for r in judged.where("fits").groupBy("shard").agg(F.sum("c").alias("c")).collect():
        held[r["shard"]] = int(r["c"])
    rest = judged.where("not fits").groupBy("g").agg(F.sum("c").alias("all")).withColumn("small", -F.col("all"))
    laid = running_total(rest, [], ["small", "g"], "all", "begin", buckets)
    ranges, end = [], 0
    for s in sorted(range(len(quota)), key=lambda s: held[s] - quota[s]):
        begin, end = end, end + quota[s] - held[s]
        ranges.append(F.struct(F.lit(begin).cast("long").alias("a"), F.lit(end).cast("long").alias("b"), F.lit(s).alias("shard")))
    inside = F.filter(F.array(*ranges), lambda r: (r["a"] < F.col("begin") + F.col("all")) & (r["b"] > F.col("begin")))
    cut = laid.select("g", "begin", "all", F.explode(inside).alias("r")).select("g", "r.shard", (F.least(F.col("r.b"), F.col("begin") + F.col("all")) - F.greatest("r.a", "begin")).alias("c"))
    out = materialise(judged.where("fits").select("g", "shard", "c").union(cut.where("c > 0")))
    for r in out.groupBy("shard").agg(F.sum("c").alias("c")).collect():
        held[r["shard"]] = int(r["c"])
    return out, held


def shard_documents(df: DataFrame, n_shards: int = 16, rounds: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and n_copies for every row.

    size is the UTF-8 bytes of the text plus 1, slot counts from 0 in every shard without gaps, and
    grown_shard is null, as the law is ``rows``. A null text counts as an empty one and is linked to
    empty ones; null ids are ordinary values; repeated rows are separate rows with slots of their own; an
    empty table gives an empty result; other columns of ``df`` are not read. A group larger than a shard
    takes about as few shards as the quotas leave room for; ``rounds`` bounds the effort, the counts are even whatever it is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g"), F.lit(1).alias("one")))
    n = rows.count()
    buckets = buckets_for(n)
    quota = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    hashed = F.pmod(F.xxhash64("doc_id", "g"), F.lit(n_shards)).cast("int").alias("shard")
    counted = rows.groupBy("g", hashed).agg(F.count("*").alias("c"))
    several = Window.partitionBy("g")
    linked = counted.withColumn("all", F.sum("c").over(several)).where("all > 1").drop("all")
    state, held = even_out(propagate(linked, quota, rounds, buckets), quota, buckets)

    # rows of a group take its shards in turn: the places of each shard end where the next one's begin
    w = Window.partitionBy("g").orderBy("shard")
    ends = state.select("g", F.struct(F.sum("c").over(w).alias("end"), "shard").alias("part")).groupBy("g").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # n_shards parts at most
    none = F.unhex(F.lit(""))
    placed = join_split(rows, ends, ["g"], "left").withColumn("k", F.when(F.col("parts").isNotNull(), F.col("g")).otherwise(none))
    placed = running_total(placed, ["k"], ["doc_id", "g"], "one", "place", buckets)
    free, total = [], 0
    for s in range(n_shards):
        total += quota[s] - held[s]
        free.append(F.struct(F.lit(total).cast("long").alias("end"), F.lit(s).alias("shard")))
    parts = F.coalesce(F.col("parts"), F.array(*free))
    placed = placed.withColumn("shard", F.filter(parts, lambda p: p["end"] > F.col("place"))[0]["shard"])
    copies = F.when(F.col("parts").isNotNull(), F.element_at("parts", -1)["end"]).otherwise(F.lit(1))
    placed = materialise(placed.select("doc_id", "g", "size", "text_crc32", "shard", copies.cast("long").alias("n_copies"), "one"))
    # "one" first: other buckets than those that dealt the rows to shards
    slotted = running_total(placed, ["shard"], ["one", "doc_id", "g"], "one", "slot", buckets)
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_copies")
