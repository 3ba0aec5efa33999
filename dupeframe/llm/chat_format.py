"""Operator 8: each dialogue once for every participant, who then speaks as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURNS_PER_ROW = 256
# The marks of the chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# What marks begin with, and what stands for that in names and words, so that no one can write a turn.
MARK, ESCAPED = "<|im_", "<| im_"


def _harmless(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(ESCAPED))


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = "system",
    unnamed: str = "unknown",
    turns_per_row: int = TURNS_PER_ROW,
) -> DataFrame:
    """Rows (conv_id, speaker, part, n_turns, text, spans, trained_chars).

    For every participant of a conversation, ``text`` renders it with that participant as the
    assistant, all others as users with their names, and ``system`` turns as they are (the
    system is no participant; a conversation of system turns only has no rows). ``spans`` are
    the (start, end) code points to train on: the participant's words and their closing mark.

    A row holds the turns of one ``part``, the turn numbers divided by ``turns_per_row``: one row
    for usual dialogues, and a conversation with a third of all turns is dealt over many tasks
    and rows, none of which grows with it. Turns are in order of number, speaker and text, so
    ties and repeated rows are all rendered. What looks like a mark in a name or in words is
    written apart, and line ends in a name are spaces, so a turn cannot pose as others. A null speaker is ``unnamed``, a null text empty, a
    null turn comes in a part of its own (null), a null conversation is a conversation.
    Other columns are not read. No rows: no rows.
    """
    read = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.translate(_harmless(F.coalesce(F.col(speaker_col).cast("string"), F.lit(unnamed))), "\r\n", "  ").alias("name"),
        _harmless(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"),
    ).withColumn("part", F.floor(F.col("turn") / turns_per_row))
    parts = read.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "name", "body"))).alias("turns"))
    people = read.where(F.col("name") != system).select(
        F.col("conv_id").alias("_conv"), F.col("name").alias("speaker")).distinct()
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def mine(t: Column) -> Column:
        return t["name"] == F.col("speaker")

    def head(t: Column) -> Column:
        who = F.when(mine(t), F.lit("assistant")).when(t["name"] == system, F.lit(system)).otherwise(
            F.concat(F.lit("user name="), t["name"]))
        return F.concat(F.lit(OPEN), who, F.lit("\n"))

    pieces = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["body"], F.lit(CLOSE)).alias("body"), mine(t).alias("mine")))
    sized = each.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        opens = state["at"] + F.length(p["head"])
        ends = opens + F.length(p["body"])
        span = F.struct(opens.alias("start"), ends.alias("end"))
        grown = F.when(p["mine"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(ends.alias("at"), grown.alias("spans"))

    spans = F.aggregate("pieces", start, add, lambda s: s["spans"])
    return sized.withColumn("spans", spans).select(
        "conv_id", "speaker", "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        "spans",
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).alias("trained_chars"),
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations from the perspective of each participant, spans as text (start:end,...)."""
    rotated = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    span = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rotated.select(
        "conv_id", "speaker", "part", F.col("n_turns").cast("long").alias("n_turns"), "text",
        F.array_join(span, ",").alias("spans"), F.col("trained_chars").cast("long").alias("trained_chars"))


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, turn, turn // 256 AS part,
    translate(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), chr(13) || chr(10), '  ') AS name,
    replace(coalesce(text, ''), '<|im_', '<| im_') AS body
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, name AS speaker FROM turns WHERE name <> 'system'
), rendered AS (
  SELECT conv_id, speaker, part, turn, name, body, name = speaker AS mine,
    '<|im_start|>' || CASE WHEN name = speaker THEN 'assistant' WHEN name = 'system' THEN 'system'
                           ELSE 'user name=' || name END || chr(10) AS head,
    body || '<|im_end|>' || chr(10) AS tail
  FROM turns JOIN people USING (conv_id)
), placed AS (
  SELECT *, sum(length(head) + length(tail)) OVER (
    PARTITION BY conv_id, speaker, part ORDER BY turn, name, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends FROM rendered
)
SELECT conv_id, speaker, part, count(*) AS n_turns,
  string_agg(head || tail, '' ORDER BY turn, name, body) AS text,
  coalesce(string_agg((ends - length(tail))::VARCHAR || ':' || ends::VARCHAR, ',' ORDER BY turn, name, body)
           FILTER (mine), '') AS spans,
  coalesce(sum(length(tail)) FILTER (mine), 0)::BIGINT AS trained_chars
FROM placed GROUP BY conv_id, speaker, part
"""
