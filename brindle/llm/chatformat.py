"""Chat formatting: each participant of a dialogue in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Speakers that set the scene: rendered as they are in every perspective, never the assistant.
SCENE = ("system", "tool")


def perspectives(turns: DataFrame, scene: tuple[str, ...] = SCENE) -> DataFrame:
    """One row for each row of turns(conv_id, turn, role, text) and participant of its conversation: conv_id, perspective, turn,
    speaker, role, segment, mask_begin, mask_end.

    In the rows of a perspective, its own turns have role assistant, others' role user and their speaker's name in the header, and
    scene roles stay. segment is the turn as rendered, "<|role|>" or "<|user name|>", a line end, the text, "<|end|>" and a line end;
    a dialogue is its segments by turn. Training loss counts on the characters mask_begin <= i < mask_end of a segment: text and
    end mark of the assistant's turns; elsewhere both are 0. A dialogue is never gathered: a conversation of any length is rows,
    and participants are joined by conversation, which Spark splits where one is hot.

    A null or blank role is the speaker "unknown". A null text is empty. "<|" in a text or name becomes "< |", so that it can't end a
    turn. A null conv_id is a conversation of its own, a null turn a turn. Repeated rows give repeated rows. A conversation of
    scene roles only has no perspective and no rows. Other columns are ignored; empty in, empty out.
    """
    name = F.trim(F.coalesce(F.col("role"), F.lit("")))
    said = turns.select("conv_id", "turn", F.when(name == "", "unknown").otherwise(name).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    people = said.where(~F.col("speaker").isin(*scene)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    own, staged = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*scene)
    role = F.when(own, "assistant").when(staged, F.col("speaker")).otherwise("user")
    shown = F.replace("speaker", F.lit("<|"), F.lit("< |"))
    head = F.concat(F.lit("<|"), F.when(own, F.lit("assistant")).when(staged, shown).otherwise(F.concat(F.lit("user "), shown)), F.lit("|>\n"))
    long = F.length("head").cast("long")
    return (
        said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .select("conv_id", "perspective", "turn", "speaker", role.alias("role"), head.alias("head"), "text", own.alias("own"))
        .select("conv_id", "perspective", "turn", "speaker", "role", F.concat("head", "text", F.lit("<|end|>\n")).alias("segment"), F.when(F.col("own"), long).otherwise(0).alias("mask_begin"), F.when(F.col("own"), long + F.length("text") + 7).otherwise(0).alias("mask_end"))
    )


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, ''), ' ') = '' THEN 'unknown' ELSE trim(role, ' ') END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker NOT IN ('system', 'tool')),
r AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.speaker = p.perspective AS own, s.text,
         CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker IN ('system', 'tool') THEN s.speaker ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (
  SELECT *, '<|' || CASE WHEN role = 'user' THEN 'user ' || replace(speaker, '<|', '< |') ELSE role END || '|>' || chr(10) AS head FROM r)
SELECT conv_id, perspective, turn, speaker, role, head || text || '<|end|>' || chr(10) AS segment,
       CASE WHEN own THEN CAST(length(head) AS BIGINT) ELSE 0 END AS mask_begin,
       CASE WHEN own THEN CAST(length(head) + length(text) + 7 AS BIGINT) ELSE 0 END AS mask_end
FROM h
"""
