"""Fill-in-middle: cut a text at two ranks of lines and deal prefix, suffix and middle out behind markers.

The cuts are found in an indexable skip list of the text's lines. Every link of every lane carries how many lines and how
many code points it passes, so a descent by accumulated lines stops at a rank and knows its place in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: markers of prefix, suffix and middle
MARKERS = ("<P>", "<S>", "<M>")


def line_points(text: np.ndarray) -> np.ndarray:
    """Code points of each line (its break included) of a text in UTF-8 bytes."""
    ends = np.flatnonzero(text == 10) + 1
    if len(text) and (not len(ends) or ends[-1] < len(text)):
        ends = np.append(ends, len(text))
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    return np.add.reduceat(((text & 0xC0) != 0x80).astype(np.int64), starts)


def tower_heights(n: int) -> np.ndarray:
    """How many express lanes stop at each of n units: k or more at a share of 4^-k, by a hash of the unit's number."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    low = x & (~x + np.uint64(1))  # the lowest bit that is set
    return np.where(x == 0, 31, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 2)


class SkipList:
    """Units of a text under express lanes. ``find(rank)`` gives the code points before that rank in logarithmic steps.

    A lane is three lists over its nodes (the first is the head): units and code points that the link to the next node, or
    to the end, passes, and the node's place in the lane below. A skip list of n units holds about 4/3 n links.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        at, heights = np.arange(self.n), tower_heights(self.n)
        places = at
        while len(at):
            units, width = np.diff(np.append(at, self.n)), np.add.reduceat(points, at)
            self.lanes.append((units.tolist(), width.tolist(), places.tolist()))
            if len(at) == 1:
                break
            stays = heights[at] >= len(self.lanes)
            stays[0] = True
            places = np.flatnonzero(stays)
            at = at[places]

    def find(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node = passed = points = 0
        for units, width, places in reversed(self.lanes):
            last = len(units)
            while node < last and passed + units[node] <= rank:
                passed += units[node]
                points += width[node]
                node += 1
            if passed == rank:
                return points
            node = places[node]
        return points


def cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """For each text, from two hashes: its lines, and the code points of prefix and middle."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    n, prefix, middle = (np.zeros(len(texts), np.int64) for _ in range(3))
    a, b = first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        lines = SkipList(line_points(data[offsets[i] : offsets[i + 1]]))
        one, two = sorted((int(a[i]) % (lines.n + 1), int(b[i]) % (lines.n + 1)))
        n[i], prefix[i] = lines.n, lines.find(one)
        middle[i] = lines.find(two) - prefix[i]
    return pa.StructArray.from_arrays([pa.array(x) for x in (n, prefix, middle)], names=["n", "prefix_chars", "middle_chars"])


def hashes(seed: int, key: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    df: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """Columns ``keep`` with n (lines), form, prefix_chars, middle_chars and output for every row.

    Out of 100 texts, ``rate`` are transformed, ``spm_rate`` of these with the suffix first; hashes of ``seed`` and key decide, so
    reruns agree. form is ``plain`` (output is the text, lengths are null) for texts that aren't transformed, are empty or null or
    contain a marker, else ``psm`` or ``spm``. Null keys hash as an empty string; rows with equal keys get the same
    hashes; texts of one line are cut before or after it. Whole texts are cut, however long; repeated rows stay
    repeated; an empty table gives an empty result; other columns of ``df`` aren't read.
    """
    starts = {m[:1] for m in markers}
    if len(set(markers)) < 3 or "" in starts or any(c in starts for m in markers for c in m[1:]):
        raise ValueError("markers must differ and have their first characters nowhere else")
    p, s, m = map(F.lit, markers)
    h1, h2, h3, h4 = hashes(seed, F.col(key_col))
    text = F.coalesce(F.col("_text"), F.lit(""))
    cut = F.arrow_udf(cuts, "struct<n: long, prefix_chars: long, middle_chars: long>")
    marked = text.contains(p) | text.contains(s) | text.contains(m)
    plain = (text == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    placed = df.withColumn("_text", F.col(text_col)).select(*keep, "_text", form.alias("_form"), h1.alias("_h1"), h2.alias("_h2")).withColumn("_cut", cut("_text", "_h1", "_h2"))
    before, inside = F.col("_cut.prefix_chars").cast("int"), F.col("_cut.middle_chars").cast("int")
    prefix, middle = F.substring(text, F.lit(1), before), F.substring(text, before + 1, inside)
    suffix = F.substring(text, before + inside + 1, F.lit(2**31 - 1))
    output = F.when(F.col("_form") == "plain", text).when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("_form") != "plain"
    return placed.select(
        *keep,
        F.col("_cut.n").alias("n"),
        F.col("_form").alias("form"),
        F.when(moved, F.col("_cut.prefix_chars")).alias("prefix_chars"),
        F.when(moved, F.col("_cut.middle_chars")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    places = [F.instr(output, m) for m in markers]
    part = lambda k, to: F.substring(output, places[k] + len(markers[k]), F.lit(2**31 - 1) if to is None else places[to] - places[k] - len(markers[k]))
    psm, spm = F.concat(part(0, 1), part(2, None), part(1, 2)), F.concat(part(0, 2), part(2, None), part(1, 0))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


INFILLING_SQL = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS k FROM hashed),
ranked AS (SELECT *, len(u) AS n, least(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS lo, greatest(k[1] % (len(u) + 1), k[2] % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 100 THEN 'plain' WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1 : lo], '') AS p, array_to_string(u[lo + 1 : hi], '') AS m, array_to_string(u[hi + 1 : n], '') AS s FROM ranked)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
