"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant, all others as named users, and the loss mask on the
assistant's turns. A rendered dialogue is the concatenation of its segments;
there is one row per segment with its code-point offsets in the dialogue, so a
conversation of any length never has to fit into one row or task. Offsets are
sums over blocks of turns, then inside the block.

A segment is ``<|im_start|>role[ name=x]\\n`` + text + ``<|im_end|>\\n``; the
mask covers the text and its end mark. ``<|`` inside a text or name becomes
``< |``, so a turn cannot forge a mark.

Defined cases: the role ``system`` is no participant and stays a system turn; a
null or empty role is the participant ``unknown``; white space and marks in a
role become ``_``; a null text is empty; turns are ordered by number (null
first), then role, then text, and repeated rows are rendered as often as they
occur; rows without a conv_id are one conversation; a conversation of system
turns only gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in one block of offsets.
BLOCK = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, seq, turn, role, name, segment, start, end, mask_start, mask_end."""
    role = F.regexp_replace(F.coalesce(F.col("role"), F.lit("")), r"[\s<|>]+", "_")
    turns = conversations.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("k"),
        "turn",
        F.when(role == "", "unknown").otherwise(role).alias("who"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).cast("long"))
    speakers = turns.where(F.col("who") != "system").select("k", F.col("who").alias("perspective")).distinct()
    own = F.col("who") == F.col("perspective")
    role_as = F.when(own, "assistant").when(F.col("who") == "system", "system").otherwise("user")
    name = F.when(~own & (F.col("who") != "system"), F.col("who"))
    head = F.concat(F.lit(OPEN), role_as, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    rows = turns.join(speakers, "k").select(
        "conv_id", "k", "perspective", "block", "turn", "who", "said",
        role_as.alias("role"), name.alias("name"), F.length(head).alias("head"),
        F.concat(head, F.col("said"), F.lit(CLOSE)).alias("segment"),
    )
    rows = rows.withColumn("long", F.length("segment").cast("long"))
    key = ["k", "perspective"]
    blocks = rows.groupBy(*key, "block").agg(F.sum("long").alias("chars"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*key, "block", F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy(*key, "block").orderBy("turn", "who", "said")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("seq", F.row_number().over(inside) - 1).withColumn("at", F.coalesce(F.sum("long").over(before), F.lit(0))).join(offsets, [*key, "block"])
    start = F.col("at") + F.col("chars_before")
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("seq") + F.col("n_before")).alias("seq"),
        "turn",
        "role",
        "name",
        "segment",
        start.alias("start"),
        (start + F.col("long")).alias("end"),
        F.when(trained, start + F.col("head")).alias("mask_start"),
        F.when(trained, start + F.col("long") - 1).alias("mask_end"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, CASE WHEN r = '' THEN 'unknown' ELSE r END AS who, replace(coalesce(text, ''), '<|', '< |') AS said
  FROM (SELECT *, regexp_replace(coalesce(role, ''), '[\\s<|>]+', '_', 'g') AS r FROM conversations)
), p AS (
  SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, who, said,
    CASE WHEN who = perspective THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN who <> perspective AND who <> 'system' THEN who END AS name
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (
  SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM s
), g AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS segment FROM h
), o AS (
  SELECT *, row_number() OVER w - 1 AS seq,
    coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0
  FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, who, said)
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, role, name, segment, CAST(s0 AS BIGINT) AS "start", CAST(s0 + length(segment) AS BIGINT) AS "end",
  CASE WHEN role = 'assistant' THEN CAST(s0 + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN role = 'assistant' THEN CAST(s0 + length(segment) - 1 AS BIGINT) END AS mask_end
FROM o
"""
