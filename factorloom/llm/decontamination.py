"""Benchmark decontamination by winnowing, with DataFrame operations only.

The k-gram hashes of a text are thinned to the least hash of every run of ``window - k + 1`` neighbours,
so any shared span of ``window`` words shares a kept hash. Kept hashes of the corpus are joined with those
of the benchmark; the texts that meet are extended to exact window matches, and everything else is done.
Items shorter than a window are looked up whole, by one hash of their own length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialise, sized

#: all ASCII but letters and digits ends a word
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words in their own case; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def grams(hashes: Column, n: int) -> Column:
    """Hashes of all n-grams of an array of word hashes; fewer than n words give none."""
    rolled = F.transform(hashes, lambda h, i: F.xxhash64(F.lit(n), h, *[F.get(hashes, i + j) for j in range(1, n)]))
    return F.slice(rolled, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


def winnow(hashes: Column, run: int) -> Column:
    """The least of every ``run`` neighbours; fewer give none."""
    least = F.transform(hashes, lambda h, i: F.least(h, *[F.get(hashes, i + j) for j in range(1, run)]))
    return F.slice(least, 1, F.greatest(F.size(hashes) - (run - 1), F.lit(0)))


def kept_hashes(df: DataFrame, text_col: str, keep: list[str], k: int, window: int, short: list[int], whole: bool) -> DataFrame:
    """(keep..., hash): the winnowed hashes of each text, and the grams of each short length.

    ``whole``: a text of a short length gives one hash of itself (benchmark items), else all its grams.
    Words are hashed in lower case of any script: a coarser test than the exact one that follows.
    """
    hashed = df.select(*keep, F.transform(words(F.col(text_col)), lambda w: F.xxhash64(F.lower(w))).alias("_h"))
    parts = hashed.select(*keep, "_h", grams(F.col("_h"), k).alias("_g"))
    lists = [winnow(F.col("_g"), window - k + 1), *[F.when(F.size("_h") == n, grams(F.col("_h"), n)).otherwise(F.array().cast("array<long>")) if whole else grams(F.col("_h"), n) for n in short]]
    return parts.select(*keep, F.explode(F.array_distinct(F.concat(*lists))).alias("hash"))


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and ``keep``, for every row.

    A window is ``window`` words of an item, or all words of a shorter one; words are compared with A-Z
    in lower case. Null texts and texts without words have no hits; items without words have no windows;
    items whose id is null count as hits but are not listed. Rows with equal texts are matched once and
    each get the result. Empty tables give results without hits. No other columns are read.
    """
    item_words = benchmark.select(F.col(item_col).cast("string").alias("item"), F.transform(words(F.col(item_text_col)), lambda w: F.translate(w, UPPER, LOWER)).alias("w"), F.col(item_text_col).alias("_text"))
    items = materialise(item_words.withColumn("n", F.size("w")).where("n > 0"))
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # at most window - 1 values

    def windows(w: Column, n: int) -> Column:
        at = F.transform(w, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, n)]))
        return F.slice(at, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))

    spans = items.select("item", F.explode(F.when(F.col("n") >= window, windows(F.col("w"), window)).otherwise(F.array(F.concat_ws(" ", "w")))).alias("span"), F.least("n", F.lit(window)).alias("length")).distinct()
    spans = materialise(spans)
    marks = sized(materialise(kept_hashes(items, "_text", [], k, window, short, True).distinct()))

    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("key")
    corpus = df.select(key, F.col(text_col).alias("_text"))
    suspects = kept_hashes(corpus, "_text", ["key"], k, window, short, False).join(marks, "hash", "left_semi").select("key").distinct()
    suspects = sized(materialise(suspects))
    near = corpus.join(suspects, "key", "left_semi").groupBy("key").agg(F.first("_text").alias("_text"))
    near = near.select("key", F.transform(words(F.col("_text")), lambda w: F.translate(w, UPPER, LOWER)).alias("w"))
    found = [near.select("key", F.posexplode(windows(F.col("w"), n)).alias("at", "span")).withColumn("length", F.lit(n)) for n in [window, *short]]
    hits = materialise(reduce(DataFrame.unionByName, found).join(sized(materialise(spans.select("span", "length").distinct()), F.octet_length("span")), ["span", "length"]))

    before = F.coalesce(F.max(F.col("at") + F.col("length")).over(Window.partitionBy("key").orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = hits.withColumn("fresh", F.greatest(F.lit(0), F.col("at") + F.col("length") - F.greatest(before, F.col("at")))).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    listed = hits.select("key", "span", "length").distinct().join(spans, ["span", "length"]).where("item is not null").select("key", "item").distinct().groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("found"))
    per_text = sized(materialise(covered.join(listed, "key", "left")), F.aggregate("found", F.lit(0), lambda n, x: n + F.length(x) + 24))
    base = df.select(F.col(id_col).alias("doc_id"), *keep, key, F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    found_items = F.coalesce("found", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(per_text, "key", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found_items).cast("long").alias("n_items"), F.sha2(F.array_join(found_items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *[c for c in keep if c != "doc_id"])


#: the same by brute force, in DuckDB
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS span
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM s),
v AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS span
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, n WHERE len(w) >= n)),
h AS (SELECT r, p, v.n, s.item_id FROM v JOIN s ON v.n = s.n AND v.span = s.span),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN i ON d.r = i.r
"""
