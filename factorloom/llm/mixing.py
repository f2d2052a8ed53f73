"""Mixing sources to target weights along a low-discrepancy schedule, with DataFrame operations only.

Each source's documents are shuffled by a hash and laid end to end; the stream is cut into blocks of
equally many words, up to one, and may be read more than once. Slot i of the schedule takes the golden-ratio point
frac(i * phi), which falls to a source through the cumulative target weights; the r-th slot of a source
takes its r-th block, and what a document's blocks with a slot hold of it is taken. Points of that sequence are spread evenly, so any
stretch of the schedule has the sources in their proportions up to a few slots; the mix itself is given out by slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import buckets_for, materialise, row_key, running_total

GOLDEN = 0.6180339887498949
SLOTS_PER_BUCKET = 4_096


def word_count(text):
    """Number of runs of other than ASCII white space: its first characters."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    # in a text that starts with a space, each word begins after one: what is left of " x" when all else goes
    return F.size(F.array_remove(F.split(plain, " +"), "")).cast("long")


def target_words(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, take the weights in turn; ``share`` of all words is divided
    by weight, no target exceeds ``most`` times its source, and what exceeds goes to the others by weight.
    That ends where target = least(most * size, level * weight), with the level found from running sums over
    the sources in the order in which they reach their bound. One row per source only.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    w = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.array(*[F.lit(float(x)) for x in weights])[F.pmod("rank", F.lit(n))])
    w = w.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    every = Window.partitionBy()
    w = w.withColumn("full", F.sum("bound").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rest", F.sum("weight").over(by.rowsBetween(1, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("full")) / F.col("rest"))
    first = F.min(F.col("bound") / F.col("weight")).over(every)
    start = F.sum("source_size").over(every) * F.lit(float(share)) / F.sum("weight").over(every)
    after = F.lead(F.col("bound") / F.col("weight")).over(by)
    here = F.when((F.col("level") >= F.col("bound") / F.col("weight")) & (F.col("level") <= after), F.col("level"))
    level = F.when(start <= first, start).otherwise(F.min("here").over(every))
    w = w.withColumn("after", after).withColumn("here", here).withColumn("level", level)
    return w.select("source", "source_size", F.coalesce(F.least("bound", F.col("level") * F.col("weight")), F.col("bound")).alias("target"))


def mix_sources(df: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block_words: int = 2_048, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and last_slot (null if nothing is taken), source, and row_key, for every row.

    A document's words that the mix takes are counted with repeats: ``taken`` is at most ``most`` times
    its size, and the sum over a source is its target rounded down. Null texts and texts without words
    have size 0 and nothing taken; a null source is a source of its own, last in the order; repeated rows
    are separate rows; an empty table gives an empty result. The same rows give the same mix.
    Targets and cumulative weights are one row per source, sorted in one small window.
    """
    spark = df.sparkSession
    base = materialise(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_key(F.col(id_col), F.col(text_col)).alias("row_key")))
    base = base.withColumn("h", F.xxhash64(F.lit(seed), "row_key"))
    # the null source needs a key that joins
    base = base.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    sizes = base.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = materialise(target_words(sizes.select("source", "source_size"), weights, share, most).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    quota = F.floor(F.col("target") + 1e-6).cast("long")
    totals = targets.agg(F.coalesce(F.sum(F.ceil(quota / F.lit(block_words))), F.lit(0)).alias("slots")).first()
    slots_n = int(totals["slots"])
    rows_n = base.count()

    # schedule: slot -> source by the golden-ratio point, rank of the slot in its source
    all_ = Window.partitionBy()
    order = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    cuts = targets.withColumn("blocks", F.ceil(quota / F.lit(block_words)).cast("long")).withColumn("to", F.sum("target").over(order) / F.sum("target").over(all_))
    cuts = materialise(cuts.withColumn("from", F.lag("to", 1, 0.0).over(Window.orderBy("s"))).select("s", "blocks", "from", "to"))
    # cumulative weights looked up by bins: each source covers the bins that its interval meets
    bins = 1_024
    cut_bins = cuts.where("to > from").withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") * bins), F.least(F.floor(F.col("to") * bins), F.lit(bins)))))
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    slots = spark.range(slots_n).withColumnRenamed("id", "slot").withColumn("u", point).withColumn("bin", F.floor(F.col("u") * bins))
    dealt = slots.join(cut_bins, "bin").where("u >= `from` and u < `to`").withColumn("part", F.floor(F.col("slot") / SLOTS_PER_BUCKET))
    dealt = materialise(dealt.select("s", "slot", "part"))
    part_n = dealt.groupBy("s", "part").agg(F.count("*").alias("c"))
    part_n = part_n.withColumn("begin", F.coalesce(F.sum("c").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.join(part_n, ["s", "part"]).withColumn("r", F.col("begin") + F.row_number().over(Window.partitionBy("s", "part").orderBy("slot")) - 1)
    # a source may get a few slots too few: its last blocks have the slots where they would be if it came at even steps
    got = part_n.groupBy("s").agg(F.sum("c").alias("got"))
    short = cuts.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("blocks > got")
    late = short.select("s", "blocks", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("r")).withColumn("slot", F.floor((F.col("r") + 0.5) / F.col("blocks") * slots_n))
    schedule = ranked.select("s", "r", "slot").unionByName(late.select("s", "r", "slot"))

    # blocks: pieces of each pass over a source's shuffled documents
    laid = running_total(base.where("size > 0"), ["s"], ["h", "row_key"], "size", "lo", buckets_for(rows_n))
    laid = materialise(laid.join(targets.select("s", "source_size", "target"), "s"))
    passes = laid.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-int(most * 1000) // 1000) - 1)))))
    begin = F.col("lo") + F.col("pass") * F.col("source_size")
    pieces = passes.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), quota)).where("end > begin")
    # a source's blocks have q words each, the first e of them one more
    blocks = F.ceil(quota / F.lit(block_words)).cast("long")
    pieces = pieces.withColumn("q", F.floor(quota / blocks)).withColumn("e", quota - F.col("q") * blocks).withColumn("turn", F.col("e") * (F.col("q") + 1))
    block_of = lambda x: F.when(x < F.col("turn"), F.floor(x / (F.col("q") + 1))).otherwise(F.col("e") + F.floor((x - F.col("turn")) / F.col("q")))
    start_of = lambda r: r * F.col("q") + F.least(r, F.col("e"))
    pieces = pieces.withColumn("r", F.explode(F.sequence(block_of(F.col("begin")), block_of(F.col("end") - 1))))
    words = F.least("end", start_of(F.col("r") + 1)) - F.greatest("begin", start_of(F.col("r")))
    taken = pieces.select("s", "lo", "r", words.alias("words")).join(schedule, ["s", "r"]).groupBy("s", "lo").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    out = laid.join(taken, ["s", "lo"], "left")
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("first_slot").cast("long").alias("first_slot"), F.col("last_slot").cast("long").alias("last_slot"), "source", "row_key"]
    bare = base.where("size = 0").join(targets.select("s", "source_size", "target"), "s").withColumn("taken", F.lit(0)).withColumns({"first_slot": F.lit(None), "last_slot": F.lit(None)})
    return out.select(*columns).unionByName(bare.select(*columns))


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The mix itself, in order of its slots: each row of ``df`` as often as its taken words fill its size, rounded half up; same columns.

    Rows without words are not part of a mix. Rows equal in all columns have as many copies together as each of them would have alone, the
    first of them one more where that doesn't divide; copies follow each other from the first slot to the last. Ranges of slots are
    files in order, and rows of a file are in order.
    """
    names = {k: how.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    whole = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    own = F.concat(row_key(F.col(names["id_col"]), F.col(names["text_col"])), F.hex(whole))
    taken = mix_sources(df.select(own.alias("_id"), F.col(names["text_col"]).alias("_text"), F.col(names["source_col"]).alias("_source")), **(how | {"id_col": "_id", "text_col": "_text", "source_col": "_source"}))
    each = F.floor(F.try_divide(F.col("taken"), F.col("size")) + 0.5).cast("long")
    times = taken.groupBy(F.col("doc_id").alias("_key")).agg(F.sum(each).alias("_times"), F.count("*").alias("_rows"), F.min("first_slot").alias("_first"), F.max("last_slot").alias("_last")).where("_times > 0")
    keyed = df.select(F.struct(*df.columns).alias("_row"), own.alias("_key")).join(times, "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key")) - 1
    # the n-th of m equal rows gives the copies n, n + m, n + 2 m, ...
    copies = keyed.withColumn("_n", nth).where("_n < _times").withColumn("_copy", F.explode(F.sequence(F.col("_n").cast("long"), F.col("_times") - 1, F.col("_rows"))))
    slot = F.col("_first") + (F.col("_last") - F.col("_first")) * F.col("_copy") / F.greatest(F.lit(1), F.col("_times") - 1)
    placed = copies.select("_row", slot.alias("_slot"), "_key")
    return placed.repartitionByRange("_slot", "_key").sortWithinPartitions("_slot", "_key").select("_row.*")
