"""Multi-party perspective rotation of dialogues, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and all others as
named users; system turns stay as they are. A rendering is a row per turn (its segment of the text, where it begins and
ends, and the part of it that counts in the loss), so a conversation of any length is never one row or one task: places come
from sums within stretches of BUCKET_TURNS turns, and of whole stretches before them.

Names stand for speakers one to one: in them %, |, <, >, and line ends are written as %25, %7C, %3C, %3E, %0A and %0D, and a
null speaker is ``%null``, which no other can be. Only a speaker called exactly ``system`` is the system.

Defined cases: null text is empty; null turns come first, in NULL_STRETCHES stretches by a hash of speaker and text, in these
by speaker, then text; equal turns go by speaker, then text; a null conversation id is one conversation; a conversation of
system turns alone has no rendering; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_TURNS = 1024
NULL_STRETCHES = 64
END = "<|end|>\n"
#: How characters that headers use are written in names; the first goes first.
ESCAPES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))


def shown_name(speaker: Column) -> Column:
    name = speaker.cast("string")
    for plain, written in ESCAPES:
        name = F.replace(name, F.lit(plain), F.lit(written))
    return F.coalesce(name, F.lit("%null"))


def rotated(turns: DataFrame, speaker: str = "role", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, start, mask_start, mask_end, end (code points of the rendering)."""
    bucket = F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS), F.lit(-(1 << 60)) + F.pmod(F.xxhash64("name", "text"), F.lit(NULL_STRETCHES)))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown_name(F.col(speaker)).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("bucket", bucket)
    people = own.where(F.col("name") != system).select(F.col("conv_id").alias("conv"), F.col("name").alias("perspective")).distinct()
    seen = own.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    role = F.when(F.col("name") == system, F.lit("system")).when(F.col("name") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user name="), "name", F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    seen = seen.withColumn("role", role).withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(END))).withColumn("n", F.length("segment").cast("long"))
    key = ("conv_id", "perspective", "bucket")
    inside = F.sum("n").over(Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "name", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = seen.groupBy(*key).agg(F.sum("n").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("conv_id", "perspective").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("bucket").alias("b"), before.alias("before"))
    placed = seen.withColumn("inside", inside).join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("bucket") == F.col("b")))
    end = F.col("before") + F.col("inside")
    start = end - F.col("n")
    mask_start = start + F.length("head")
    return placed.select("conv_id", "perspective", "turn", "role", "name", "segment", start.alias("start"), mask_start.alias("mask_start"), F.when(F.col("role") == "assistant", end).otherwise(mask_start).alias("mask_end"), end.alias("end"))


def several_parties(conversations: DataFrame) -> DataFrame:
    """The table of conversations as dialogues of up to four people (``speaker``): users and assistants take turns in pairs, system turns stay."""
    second = F.pmod(F.floor(F.col("turn") / 2), F.lit(2)) + 1
    return conversations.withColumn("speaker", F.when(F.col("role") == "system", F.col("role")).otherwise(F.concat("role", F.lit("|"), second)))


ORACLE_SQL = """
WITH named AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' THEN role ELSE role || '|' || (floor(turn / 2.0)::BIGINT % 2 + 1) END AS speaker, coalesce(text, '') AS text FROM conversations
), own AS (
  SELECT conv_id, turn, coalesce(replace(replace(replace(replace(replace(replace(speaker, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D'), '%null') AS name, text FROM named
), people AS (
  SELECT DISTINCT conv_id, name AS perspective FROM own WHERE name <> 'system'
), seen AS (
  SELECT own.*, perspective, CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM own JOIN people ON own.conv_id IS NOT DISTINCT FROM people.conv_id
), headed AS (
  SELECT *, CASE WHEN role = 'user' THEN '<|user name=' || name || '|>' || chr(10) ELSE '<|' || role || '|>' || chr(10) END AS head FROM seen
), cut AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM headed
), placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM cut
)
SELECT conv_id, perspective, turn, role, name, "end" - length(segment) AS start, "end" - length(segment) + length(head) AS mask_start,
  CASE WHEN role = 'assistant' THEN "end" ELSE "end" - length(segment) + length(head) END AS mask_end, "end", md5(segment) AS segment_md5
FROM placed
"""
