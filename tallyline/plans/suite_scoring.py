"""Queries over samples and predictions: pairing, scores, pooled and grouped metrics, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edit, text
from ..operators import scoring
from . import stand_ins
from .stand_ins import SAMPLES_SQL

WITH = "WITH" + SAMPLES_SQL


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.paired_predictions(stand_ins.samples(spark, sf_dir), stand_ins.predictions(spark, sf_dir))
    return scoring.scored(rows, text.ascii_key)


def jn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.paired_predictions(stand_ins.samples(spark, sf_dir), stand_ins.predictions(spark, sf_dir))
    return rows.select("sample_id", "speaker", "raw", "action", "error")


def jn02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.unexpected_predictions(stand_ins.samples(spark, sf_dir), stand_ins.predictions(spark, sf_dir))


def sc07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rated(spark, sf_dir).select("sample_id", "characters", "errors", F.round("cer", 6).alias("cer"), "offered", "exact", "automatic", F.round("rtf", 6).alias("rtf"))


METRICS = ("samples", "errors", "characters", "cer", "exact_rate", "coverage", "rejection", "automatic_coverage", "automatic_cer", "failures", "p50", "p95")
_DOUBLES = ("cer", "exact_rate", "coverage", "rejection", "automatic_coverage", "automatic_cer", "p50", "p95")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _metrics_sql(by: str) -> str:
    head = f"{by}, " if by else ""
    return (
        WITH + f"""SELECT {head}count(*) AS samples, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(characters) AS BIGINT) AS characters, round(sum(errors) / nullif(sum(characters), 0), 6) AS cer,
  round(count(*) FILTER (exact) / count(*), 6) AS exact_rate, round(count(*) FILTER (offered) / count(*), 6) AS coverage, round(1 - count(*) FILTER (offered) / count(*), 6) AS rejection,
  round(count(*) FILTER (automatic) / count(*), 6) AS automatic_coverage, round(sum(errors) FILTER (automatic) / nullif(sum(characters) FILTER (automatic), 0), 6) AS automatic_cer, count(error) AS failures,
  round(quantile_cont(CAST(processing_seconds AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(processing_seconds AS DOUBLE), 0.95), 6) AS p95 FROM rated""" + (f" GROUP BY {by}" if by else "")
    )


def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.pooled(rated(spark, sf_dir)))


def grouped(by: str):  # noqa: ANN201
    return lambda spark, sf_dir: _rounded(scoring.pooled(rated(spark, sf_dir), by))


def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.sessions_per_speaker(stand_ins.samples(spark, sf_dir))


def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.nearest_rank("processing_seconds", 0.95, "speaker")(rated(spark, sf_dir)))


def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.report_metrics(rated(spark, sf_dir), "speaker"))


def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groupings in one pass: speaker, length bucket, domain."""
    rows = rated(spark, sf_dir).withColumn("bucket", text.length_bucket(F.col("characters")))
    sets = rows.groupingSets([["speaker"], ["bucket"], ["domain"]], "speaker", "bucket", "domain")
    return _rounded(sets.agg(F.count("*").alias("samples"), F.sum("errors").alias("errors"), scoring.ratio(F.sum("errors"), F.sum("characters")).alias("cer")))


def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed duration bins, also the empty ones."""
    bins = spark.createDataFrame([(b,) for b in ("(0,2]", "(2,4]", "(4,8]", "(8,16]", "(16,+inf)", "unknown")], "bucket string")
    rows = rated(spark, sf_dir).withColumn("bucket", text.duration_bucket(F.col("duration_seconds")))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("errors").alias("e"))
    return F.broadcast(bins).join(sums, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("samples"), F.coalesce("e", F.lit(0)).alias("errors"))


def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled word error rate by speaker, with the word-array distance."""
    rows = rated(spark, sf_dir).withColumns({"rw": text.words(F.col("reference")), "hw": text.words(F.col("raw"))})
    rows = rows.withColumns({"edits": edit.token_distance("hw", "rw"), "words": F.size("rw").cast("long")})
    return scoring.word_metrics(rows, "speaker")


def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir)
    metrics = scoring.pooled(rows).crossJoin(scoring.sessions_per_speaker(rows))  # one row each
    return _rounded(scoring.gates(metrics, scoring.Thresholds()))


def val_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import validation

    return validation.violations(stand_ins.samples(spark, sf_dir), validation.sample_rules(), "sample_id")


def set07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.duplicated(stand_ins.samples(spark, sf_dir), "sha256")


def sc02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character errors of every turn against the next one of its conversation, on whole texts: a heavy use of the built-in distance."""
    turns = stand_ins.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.ascii_key(F.col("text")).alias("k"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("k").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", edit.distance(F.col("k"), F.col("next")).alias("errors"), F.length("next").cast("long").alias("characters"))


QUERIES = {
    "jn01_samples_left_join_predictions": (jn01, WITH + "SELECT sample_id, speaker, raw, action, error FROM rated"),
    "jn02_unexpected_predictions": (jn02, WITH + "SELECT DISTINCT sample_id FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.sample_id = p.sample_id)"),
    "sc02_character_errors": (sc02, "WITH k AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM conversations) SELECT a.conv_id, a.turn, levenshtein(a.k, b.k) AS errors, length(b.k) AS characters FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"),
    "sc07_row_scores": (sc07, WITH + "SELECT sample_id, characters, errors, round(cer, 6) AS cer, offered, exact, automatic, round(rtf, 6) AS rtf FROM rated"),
    "agg01_pooled_metrics": (agg01, _metrics_sql("")),
    "agg01_pooled_metrics_by_domain": (grouped("domain"), _metrics_sql("domain")),
    "agg07_metrics_by_speaker": (grouped("speaker"), _metrics_sql("speaker")),
    "agg02_sessions_per_speaker": (agg02, WITH + "SELECT count(*) AS speakers, min(n) AS min_sessions FROM (SELECT speaker, count(DISTINCT session) AS n FROM samples GROUP BY speaker)"),
    "agg04_nearest_rank_p95": (agg04, WITH + ", o AS (SELECT speaker, processing_seconds, row_number() OVER (PARTITION BY speaker ORDER BY processing_seconds) - 1 AS i, count(*) OVER (PARTITION BY speaker) AS n FROM rated WHERE processing_seconds IS NOT NULL) SELECT speaker, round(processing_seconds, 6) AS value FROM o WHERE i = least(n - 1, CASE WHEN 0.95 * (n - 1) % 1 = 0.5 THEN 2 * round(0.95 * (n - 1) / 2) ELSE round(0.95 * (n - 1)) END)"),
    "agg05_pair_metrics_by_speaker": (agg05, WITH + "SELECT speaker, count(*) AS samples, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(errors) AS BIGINT) AS errors, round(sum(errors) / nullif(sum(characters), 0), 6) AS cer, count(*) FILTER (exact) AS exact, count(*) FILTER (hyp_key = '') AS empty, count(error) AS failures, round(count(*) FILTER (hyp_key <> '' AND error IS NULL) / count(*), 6) AS coverage FROM rated GROUP BY speaker"),
    "agg10_grouping_sets": (agg10, WITH + ", b AS (SELECT *, CASE WHEN characters <= 20 THEN '1-20' WHEN characters <= 40 THEN '21-40' WHEN characters <= 60 THEN '41-60' ELSE '61+' END AS bucket FROM rated) SELECT speaker, bucket, domain, count(*) AS samples, CAST(sum(errors) AS BIGINT) AS errors, round(sum(errors) / nullif(sum(characters), 0), 6) AS cer FROM b GROUP BY GROUPING SETS ((speaker), (bucket), (domain))"),
    "agg17_fixed_duration_bins": (agg17, WITH + ", b AS (SELECT *, CASE WHEN duration_seconds IS NULL OR duration_seconds <= 0 THEN 'unknown' WHEN duration_seconds <= 2 THEN '(0,2]' WHEN duration_seconds <= 4 THEN '(2,4]' WHEN duration_seconds <= 8 THEN '(4,8]' WHEN duration_seconds <= 16 THEN '(8,16]' ELSE '(16,+inf)' END AS bucket FROM rated) SELECT v.bucket, count(b.sample_id) AS samples, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors FROM (VALUES ('(0,2]'), ('(2,4]'), ('(4,8]'), ('(8,16]'), ('(16,+inf)'), ('unknown')) v(bucket) LEFT JOIN b ON b.bucket = v.bucket GROUP BY v.bucket"),
    "agg24_word_error_rate": (agg24, None),
    "flt15_gates": (flt15, WITH + ", m AS (SELECT count(*) AS samples, count(DISTINCT speaker) AS speakers, (SELECT min(n) FROM (SELECT count(DISTINCT session) AS n FROM rated GROUP BY speaker)) AS min_sessions, count(*) FILTER (offered) / count(*) AS coverage, sum(errors) / nullif(sum(characters), 0) AS cer, sum(errors) FILTER (automatic) / nullif(sum(characters) FILTER (automatic), 0) AS automatic_cer, quantile_cont(CAST(processing_seconds AS DOUBLE), 0.95) AS p95 FROM rated) " + " UNION ALL ".join(f"SELECT '{c}' AS criterion, round(CAST({c} AS DOUBLE), 6) AS observed, CAST({v} AS DOUBLE) AS required, coalesce({c} {o} {v}, false) AS passed FROM m" for c, o, v in (("samples", ">=", 50), ("speakers", ">=", 5), ("min_sessions", ">=", 2), ("coverage", ">=", 0.9), ("cer", "<=", 0.15), ("automatic_cer", "<=", 0.05), ("p95", "<=", 5.0)))),
    "val01_sample_rules": (val_rules, WITH + "SELECT sample_id, 'full_face_needs_short_clip' AS rule FROM samples WHERE domain = 'full_face' AND duration_seconds > 30 UNION ALL SELECT sample_id, 'reference_is_blank' FROM samples WHERE coalesce(trim(reference), '') = '' UNION ALL SELECT sample_id, 'speaker_is_blank' FROM samples WHERE coalesce(trim(speaker), '') = '' UNION ALL SELECT sample_id, 'domain_is_unknown' FROM samples WHERE domain IS NULL OR domain NOT IN ('mouth_roi', 'full_face', 'webcam') UNION ALL SELECT sample_id, 'split_is_unknown' FROM samples WHERE split IS NULL OR split NOT IN ('train', 'dev', 'test') UNION ALL SELECT sample_id, 'duration_is_not_positive' FROM samples WHERE duration_seconds IS NULL OR duration_seconds <= 0 UNION ALL SELECT sample_id, 'digest_is_not_sha256' FROM samples WHERE sha256 IS NULL OR NOT regexp_full_match(sha256, '[0-9a-f]{64}')"),
    "set07_duplicate_keys": (set07, WITH + "SELECT sha256, count(*) AS rows FROM samples GROUP BY sha256 HAVING count(*) > 1"),
}
