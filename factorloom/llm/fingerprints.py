"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame operations only.

A sketch is the sorted array of the ``k`` least distinct hashes of a text's word shingles. The sketch of
a union is the k least of both sketches, so sketches of parts merge; two sketches estimate resemblance
and containment of their texts, and one estimates the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialise

WHITE = r"[\x20\x09-\x0D]+"
#: rows in one range of neighbours, and the most ranges (one row of each is broadcast)
BUCKET_ROWS, MOST_BUCKETS = 2_000, 100_000
#: copies of one row (id and text) that one task gives out
MANY_COPIES = 1_000


def least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: Column, out: str, k: int = 64, shingle: int = 5) -> DataFrame:
    """Add the sketch of a text. Texts of fewer words than a shingle have one, the whole; without words the sketch is empty."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")
    hashed = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col("_w")
    rolled = F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, shingle)])), 1, F.least(F.size(h), F.greatest(F.size(h) - (shingle - 1), F.lit(1))))
    return hashed.withColumn(out, least(rolled, k)).drop("_w")


def merged(a: Column, b: Column, k: int = 64) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "fingerprint", k: int = 64) -> DataFrame:
    """(keys..., sketch): one sketch for all parts of a key; only k hashes a key and task are shuffled."""
    hashes = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = 64) -> Column:
    """Estimated share of common shingles among all of both texts; 1 if neither has any."""
    both = merged(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column, k: int = 64) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in its range."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / F.greatest(place, F.lit(1e-18)))


def containment(a: Column, b: Column, k: int = 64) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    j = resemblance(a, b, k)
    common = j * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_hex(sketch: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(df: DataFrame, id_col: str, order: list[str], take: list[str]) -> DataFrame:
    """Add next_<c> for each column of ``take``: the value in the next row by ascending id (null first), then ``order``; after the last comes the first.

    Rows are dealt to ranges of the keys and written once with the range's number, whatever the type and spread of the ids; each range is sorted by
    itself. Its last row takes what begins the next range: one row a range, ``MOST_BUCKETS`` at most, joined by number. Meant for narrow rows.
    """
    keys = [F.asc_nulls_first(id_col), *order]
    ranges = max(1, min(MOST_BUCKETS, df.count() // BUCKET_ROWS))
    placed = materialise(df.repartitionByRange(ranges, *keys).withColumn("_r", F.spark_partition_id()))
    heads = placed.groupBy("_r").agg(F.min(F.struct(id_col, *order, *[F.col(c).alias(f"_take_{c}") for c in take])).alias("_head"))
    ring = Window.orderBy("_r")
    first = F.first("_head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("_r", F.coalesce(F.lead("_head").over(ring), first).alias("_after"))
    w = Window.partitionBy("_r").orderBy(*keys)
    inside = placed.withColumn("_next", F.lead(F.struct(*take)).over(w)).join(F.broadcast(after), "_r")
    at_end = F.col("_next").isNull()
    return inside.select(*df.columns, *[F.when(at_end, F.col(f"_after._take_{c}")).otherwise(F.col(f"_next.{c}")).alias(f"next_{c}") for c in take])


def fingerprint_documents(df: DataFrame, k: int = 64, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and distinct_shingles for every row.

    The edited text replaces the last quarter of the code points by as many of the next document. Null
    texts count as empty; a text without words has an empty fingerprint, which resembles empty ones
    only; ids may be of any type with an order, null ids come first; rows of equal ids follow each other by a hash of
    their texts; a single row is its own next; an empty table gives an empty result; other columns are not read.

    Rows equal in id and text are one until the end: all but the last of them have themselves as next. Neighbours are found on keys without texts; a
    document is then sent the part of its next one that it needs, with its sketch, so whole texts move by their own key only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumns({"a": F.xxhash64("doc_id", "text"), "b": F.xxhash64(F.lit(7), "text", "doc_id"), "h": F.xxhash64("text")})
    narrow = base.groupBy("a", "b").agg(F.first("doc_id").alias("doc_id"), F.first("h").alias("h"), F.first(F.length("text")).alias("n"), F.count("*").alias("copies"))
    follows = materialise(with_next(narrow, "doc_id", ["h", "a", "b"], ["a", "b"]).select("a", "b", "doc_id", "n", "copies", "next_a", "next_b"))
    once = base.groupBy("a", "b").agg(F.first("text").alias("text"))

    def results(of: DataFrame, texts: DataFrame) -> DataFrame:
        asked = of.select(F.col("next_a").alias("a"), F.col("next_b").alias("b"), F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.floor(F.col("n") / 4).cast("int").alias("cut"))
        sent = with_sketch(once, F.col("text"), "next_sketch", k, shingle).join(asked, ["a", "b"])
        sent = sent.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"), F.substring("text", F.lit(1), F.col("cut")).alias("head"), "next_sketch")
        paired = with_sketch(texts, F.col("text"), "sketch", k, shingle).join(of.drop("next_a", "next_b"), ["a", "b"]).join(sent, ["a", "b"])
        # the last copy has the next document, the others have themselves
        cut = F.floor(F.col("n") / 4).cast("int")
        last = F.struct(F.col("head"), F.col("next_sketch").alias("near"), F.lit(1).cast("long").alias("times"))
        own = F.struct(F.substring("text", F.lit(1), cut).alias("head"), F.col("sketch").alias("near"), (F.col("copies") - 1).alias("times"))
        each = paired.select("doc_id", "text", "n", "sketch", F.explode(F.when(F.col("copies") > 1, F.array(last, own)).otherwise(F.array(last))).alias("x"))
        edited = F.concat(F.substring("text", F.lit(1), F.col("n") - cut), F.col("x.head"))
        each = each.select("doc_id", F.col("n").cast("long").alias("n_chars"), "sketch", F.col("x.near").alias("near"), F.col("x.times").alias("times"), edited.alias("edited"))
        each = with_sketch(each, F.col("edited"), "other", k, shingle)
        return each.select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("sketch")).alias("fingerprint"), as_hex(F.col("other")).alias("edited_fingerprint"),
            resemblance(F.col("sketch"), F.col("other"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("near"), k).alias("near_next"), distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"), "times",
        )

    def repeated(out: DataFrame) -> DataFrame:
        return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "_copy")

    out = repeated(results(follows.where(F.col("copies") <= MANY_COPIES), once))
    hot = follows.where(F.col("copies") > MANY_COPIES)
    if not hot.isEmpty():  # their rows are told out by several tasks
        few = results(hot, once.join(hot.select("a", "b"), ["a", "b"], "left_semi"))
        runs = few.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(MANY_COPIES).cast("long"))))
        runs = runs.withColumn("times", F.least(F.lit(MANY_COPIES), F.col("times") - F.col("_run")).cast("long")).repartition("doc_id", "_run").drop("_run")
        out = out.union(repeated(runs))
    return out
