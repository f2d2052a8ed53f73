"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once more, with that speaker as the
assistant, all others as named users, and masks over what the assistant says. The rendering is kept as
segments, one row a turn, with character offsets into the whole: a conversation of any length is never
gathered into one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import join_split

START, END = "<|im_start|>", "<|im_end|>"
#: turn numbers that one window of a conversation holds
SPAN = 512


def _broken(text: Column) -> Column:
    """Text in which the marks' own text gets spaces, so that it can't end or start a turn."""
    return F.regexp_replace(text, r"<\|im_(start|end)\|>", "< |im_$1| >")


def rotate_perspectives(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """(conv_id, perspective, position, turn, segment, char_start, char_end, mask_start, mask_end): one row a turn and participant.

    The rendered dialogue of a perspective is its segments by position; char_start and char_end are their
    places in it, and mask_start to mask_end are the words of the assistant with the closing mark, null
    in other turns. Participants are the roles other than ``system``, whose turns keep that role; a
    conversation with nothing else gives no rows. A null or blank role is one participant without a name (perspective
    empty, rendered as plain ``user``). In a name that is rendered, backslashes and line breaks are escaped by a backslash and marks broken
    as in a text, so that no role can forge a turn; a null text is empty, and the marks' own text inside a turn
    gets spaces. Turns run in ascending order, null first, then by a digest of role and text; repeated rows are repeated turns; a null
    conversation id is a conversation of its own; an empty table gives an empty result.

    Offsets are running totals of three levels: ``SPAN`` turn numbers, one turn number's parts by digest, rows. So neither a
    conversation as large as a table nor one turn number for all rows is a single task.
    """
    said = _broken(F.coalesce(F.col(text_col), F.lit("")))
    role = F.when(F.trim(F.coalesce(F.col(role_col), F.lit(""))) == "", F.lit("")).otherwise(F.col(role_col))
    turns = df.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), said.alias("said"), F.col(id_col).isNull().alias("_none"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_c"))
    speakers = turns.where(F.col("role") != system).select("_none", "_c", F.col("role").alias("perspective")).distinct()
    seen = join_split(turns, speakers, ["_none", "_c"])
    own = F.col("role") == F.col("perspective")
    shown = _broken(F.replace(F.replace(F.replace(F.col("role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")))
    user = F.when(F.col("role") == "", F.lit("user")).otherwise(F.concat(F.lit("user name="), shown))
    head = F.concat(F.lit(START), F.when(F.col("role") == system, F.col("role")).when(own, F.lit("assistant")).otherwise(user), F.lit("\n"))
    seen = seen.withColumn("head", head).withColumn("segment", F.concat("head", "said", F.lit(END + "\n"))).withColumn("n", F.length("segment").cast("long"))
    seen = seen.withColumn("_d", F.md5(F.concat("role", F.lit("|"), "said"))).withColumn("_part", F.substring("_d", 1, 2)).withColumn("one", F.lit(1).cast("long"))
    seen = seen.withColumn("_span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62)))).withColumn("_turn", F.coalesce(F.col("turn").cast("string"), F.lit("")))
    keys, upto = ["_none", "_c", "perspective"], (Window.unboundedPreceding, -1)
    before = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*upto)), F.lit(0))
    parts = seen.groupBy(*keys, "_span", "_turn", "_part").agg(F.first("turn").alias("turn"), F.sum("n").alias("n"), F.count("*").alias("one"))
    spans = parts.groupBy(*keys, "_span").agg(F.sum("n").alias("n"), F.sum("one").alias("one"))
    spans = spans.select(*keys, "_span", before("n", keys, ["_span"]).alias("chars"), before("one", keys, ["_span"]).alias("rows"))
    within, inside = [*keys, "_span"], [*keys, "_span", "_turn", "_part"]
    parts = parts.join(spans, within).select(*inside, (F.col("chars") + before("n", within, ["turn", "_part"])).alias("chars"), (F.col("rows") + before("one", within, ["turn", "_part"])).alias("rows"))
    order = ["_d", "role", "said"]
    placed = seen.join(parts, inside).withColumn("char_start", F.col("chars") + before("n", inside, order)).withColumn("position", F.col("rows") + before("one", inside, order))
    spoken = F.col("char_start") + F.length("head")
    return placed.select(
        "conv_id", "perspective", "position", "turn", "segment", "char_start", (F.col("char_start") + F.col("n")).alias("char_end"),
        F.when(own, spoken).alias("mask_start"), F.when(own, F.col("char_start") + F.col("n") - 1).alias("mask_end"),
    )


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN '' ELSE role END AS role,
                  regexp_replace(coalesce(text, ''), '<\|im_(start|end)\|>', '< |im_\1| >', 'g') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT t.conv_id, p.perspective, t.turn, t.role, t.said,
             '<|im_start|>' || CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = p.perspective THEN 'assistant' WHEN t.role = '' THEN 'user'
                                      ELSE 'user name=' || regexp_replace(replace(replace(replace(t.role, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<\|im_(start|end)\|>', '< |im_\1| >', 'g') END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
g AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM s),
w AS (SELECT *, row_number() OVER o - 1 AS position, sum(length(segment)) OVER o - length(segment) AS char_start
      FROM g WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, md5(role || '|' || said), role, said ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, segment, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(segment) AS BIGINT) AS char_end,
       CASE WHEN role = perspective THEN CAST(char_start + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN role = perspective THEN CAST(char_start + length(segment) - 1 AS BIGINT) END AS mask_end
FROM w
"""
