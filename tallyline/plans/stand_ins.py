"""Stand-ins for the domain's tables, made of the supplied ones; each has the same table as DuckDB SQL for the oracles.

samples and predictions: a user's turn is a reference, the next turn its recognised text (none if it was the last one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.length("text")
    speaker = F.concat(F.lit("s"), (F.col("conv_id") % 40).cast("string"))
    split = F.when(F.col("conv_id") % 40 < 24, "train").when(F.col("conv_id") % 40 < 32, "dev").otherwise("test")
    domain = F.when(F.col("turn") == 0, "webcam").when(F.col("turn") % 4 == 2, "full_face").otherwise("mouth_roi")
    return t.select(
        F.concat("conv_id", F.lit("_"), "turn").alias("sample_id"), F.col("text").alias("reference"), speaker.alias("speaker"), F.concat(F.lit("r"), (F.col("conv_id") % 3).cast("string")).alias("session"), split.alias("split"), domain.alias("domain"),
        (n / 15).alias("duration_seconds"), F.md5("text").alias("sha256"), F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    n = F.length("text")
    action = F.when(n % 10 < 1, "retry").when(n % 10 < 6, "review").otherwise("auto")
    return t.select(F.concat("conv_id", F.lit("_"), F.col("turn") - 1).alias("sample_id"), F.col("text").alias("raw"), action.alias("action"), F.when(n % 31 == 0, "decoder failed").alias("error"), (n / 40).alias("processing_seconds"), F.col("turn").alias("ord"))


SAMPLES_SQL = """
samples AS (
  SELECT conv_id || '_' || turn AS sample_id, text AS reference, 's' || (conv_id % 40) AS speaker, 'r' || (conv_id % 3) AS session,
    CASE WHEN conv_id % 40 < 24 THEN 'train' WHEN conv_id % 40 < 32 THEN 'dev' ELSE 'test' END AS split,
    CASE WHEN turn = 0 THEN 'webcam' WHEN turn % 4 = 2 THEN 'full_face' ELSE 'mouth_roi' END AS domain,
    length(text) / 15.0 AS duration_seconds, md5(text) AS sha256, conv_id, turn
  FROM conversations WHERE role = 'user'
), predictions AS (
  SELECT conv_id || '_' || (turn - 1) AS sample_id, text AS raw, CASE WHEN length(text) % 10 < 1 THEN 'retry' WHEN length(text) % 10 < 6 THEN 'review' ELSE 'auto' END AS action,
    CASE WHEN length(text) % 31 = 0 THEN 'decoder failed' END AS error, length(text) / 40.0 AS processing_seconds, turn AS ord
  FROM conversations WHERE role = 'assistant'
), rows_ AS (
  SELECT s.*, coalesce(p.raw, '') AS raw, coalesce(p.action, 'retry') AS action, CASE WHEN p.sample_id IS NULL THEN 'Missing prediction' ELSE p.error END AS error, p.processing_seconds
  FROM samples s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ord DESC) AS r FROM predictions) p ON p.sample_id = s.sample_id AND p.r = 1
), keyed AS (
  SELECT *, regexp_replace(lower(reference), '[^a-z0-9]', '', 'g') AS ref_key, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS hyp_key FROM rows_
), offered AS (
  SELECT *, length(ref_key) AS characters, hyp_key <> '' AND action <> 'retry' AND error IS NULL AS offered FROM keyed
), scored AS (
  SELECT *, CASE WHEN offered THEN levenshtein(hyp_key, ref_key) ELSE characters END AS errors,
    CASE WHEN duration_seconds > 0 AND processing_seconds >= 0 THEN processing_seconds / duration_seconds END AS rtf FROM offered
), rated AS (
  SELECT *, CASE WHEN characters <> 0 THEN errors / characters END AS cer, offered AND errors = 0 AS exact, offered AND action = 'auto' AS automatic FROM scored
)
"""
