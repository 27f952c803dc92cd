"""Queries of the checks and small measures, and their SQL. Events stand in for frames and spans, conversations for candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks
from . import stand_ins
from .suite_sequences import _RANKED, ranked

S, D = SparkSession, DataFrame
_KINDS = "upper(event_type)"


def _events(spark: S, sf: str) -> D:
    return stand_ins.table(spark, sf, "events")


def val13(spark: S, sf: str) -> D:
    return _events(spark, sf).where(checks.bad_duration(F.col("value") - 10)).select("event_id")


def val15(spark: S, sf: str) -> D:
    """Every seventh id has a letter that is no sex, every eleventh another speaker."""
    e = _events(spark, sf)
    first = F.when(F.col("event_id") % 11 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    source = F.concat_ws("_", first, "event_id", F.when(F.col("event_id") % 7 == 0, "X").when(F.col("event_id") % 2 == 0, "M").otherwise("F"), F.upper("event_type"), F.floor("value"))
    return e.select("event_id", checks.source_issue(source, F.col("user_id").cast("string")).alias("issue")).where("issue is not null")


def val25(spark: S, sf: str) -> D:
    return stand_ins.table(spark, sf, "part").where(checks.small_frame(F.col("p_size") * 10, F.col("p_retailprice"))).select("p_partkey")


def flt16(spark: S, sf: str) -> D:
    status, gates = checks.blocked_when_synthetic(F.lit("ready"), F.array("split"), F.col("domain") == "phone")
    return stand_ins.samples(spark, sf).select("sample_id", status.alias("status"), F.array_join(gates, "|").alias("gates"))


def agg33(spark: S, sf: str) -> D:
    state = F.when(F.md5("url") < "8", "missing").otherwise("ready")
    return stand_ins.table(spark, sf, "pages").agg(checks.missing_bytes(state, F.length("html").cast("long")).alias("bytes"))


def sc43(spark: S, sf: str) -> D:
    need = checks.workspace_bytes(F.col("p_size"), 40, 5000)
    return stand_ins.table(spark, sf, "part").select("p_partkey", need.alias("bytes"), (need <= 200_000_000).alias("fits"))


def ml04(spark: S, sf: str) -> D:
    r = ranked(spark, sf)
    return r.select("sample_id", F.col("rank").cast("long").alias("rank"), F.round(checks.with_length_bonus(F.col("score"), text.words(F.col("text")), 0.5), 6).alias("score"))


def agg29(spark: S, sf: str) -> D:
    e = _events(spark, sf).withColumn("face", F.col("event_type") == "view")
    return checks.capture_measures(e, "user_id", "value", "face").select("user_id", F.round("mouth_width", 6).alias("mouth_width"), F.round("face_ratio", 6).alias("face_ratio"))


def ts04(spark: S, sf: str) -> D:
    e = _events(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return checks.capped(e, "user_id", "at", 20 * 86400.0).select("event_id")


def ts05(spark: S, sf: str) -> D:
    spans = _events(spark, sf).select("user_id", (F.floor("value") * 100 - 500).alias("a"), (F.floor("value") * 100 - 500 + F.col("event_id") % 3 * 400).alias("b"))
    return checks.speech(spans, "user_id", F.lit(5000)).select("user_id", F.round("seconds", 6).alias("seconds"), "first", "last")


def agg38(spark: S, sf: str) -> D:
    t = stand_ins.table(spark, sf, "conversations")
    samples = t.where("turn = 0").select(F.concat(F.lit("c"), F.col("conv_id") % 3).alias("config"), F.col("conv_id").alias("sample_id"), F.length(text.ascii_key(F.col("text"))).cast("long").alias("characters"))
    found = ranked(spark, sf).where("rank % 2 = 0").withColumn("config", F.concat(F.lit("c"), F.col("sample_id") % 3))
    return checks.nbest_oracle(samples, found, "config").select("config", F.round("cer", 6).alias("cer"))


def set12(spark: S, sf: str) -> D:
    d = stand_ins.table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content"))
    return checks.already_there(d.where("lang = 'en'"), d.where("lang <> 'en'").unionByName(stand_ins.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("-").alias("lang"), F.sha2("text", 256).alias("content"))), "content").select("doc_id")


def sc15(spark: S, sf: str) -> D:
    return checks.disagreement(ranked(spark, sf), F.col("text"))


def sc10(spark: S, sf: str) -> D:
    """Characters of the documents that no passage of the benchmark has; a row for each document and unit, and one for each empty target."""
    units = lambda df, i: df.select(F.col(i).alias("id"), text.target_units(F.col("text")).alias("units"))
    known = units(stand_ins.table(spark, sf, "benchmark"), "item_id").select(F.explode("units").alias("unit"))
    return checks.unsupported_units(units(stand_ins.table(spark, sf, "documents"), "doc_id"), known)


_UNITS = r"list_filter(string_split(regexp_replace(nfkc, '[\s，。！？；、：“”‘’（）【】《》,.!?;:\"''()\[\]]', '', 'g'), ''), lambda x: x <> '')"

QUERIES = {
    "val13_bad_durations": (val13, "SELECT event_id FROM events WHERE value - 10 <= 0 OR isnan(value) OR isinf(value)"),
    "val15_source_ids": (val15, "WITH i AS (SELECT event_id, user_id, concat_ws('_', CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END, event_id, CASE WHEN event_id % 7 = 0 THEN 'X' WHEN event_id % 2 = 0 THEN 'M' ELSE 'F' END, upper(event_type), floor(value)::BIGINT) AS s FROM events), j AS (SELECT event_id, CASE WHEN NOT regexp_matches(s, '^[0-9]+_[0-9]+_[MF]_[A-Z]+_[0-9]+$') THEN 'form' WHEN NOT starts_with(s, user_id || '_') THEN 'speaker' END AS issue FROM i) SELECT * FROM j WHERE issue IS NOT NULL"),
    "val25_small_frames": (val25, "SELECT p_partkey FROM part WHERE least(p_size * 10, p_retailprice) <= 160"),
    "flt16_synthetic_override": (flt16, "WITH" + stand_ins.SAMPLES_SQL + "SELECT sample_id, CASE WHEN domain = 'phone' THEN 'not_ready' ELSE 'ready' END AS status, split || CASE WHEN domain = 'phone' THEN '|synthetic_conditions' ELSE '' END AS gates FROM samples"),
    "agg33_missing_bytes": (agg33, "SELECT CAST(coalesce(sum(length(html)) FILTER (md5(url) < '8'), 0) AS BIGINT) AS bytes FROM pages"),
    "sc43_workspace_gate": (sc43, "SELECT p_partkey, CAST(6 * 2 * 40 * 5000 * 4 AS BIGINT) * p_size AS bytes, CAST(6 * 2 * 40 * 5000 * 4 AS BIGINT) * p_size <= 200000000 AS fits FROM part"),
    "ml04_length_bonus": (ml04, _RANKED + " SELECT sample_id, rank, round(length(text) / -10.0 + 0.5 * len(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '[\\x{4e00}-\\x{9fff}]|[a-z0-9]+(?:''[a-z0-9]+)*')), 6) AS score FROM ranked"),
    "agg29_capture_measures": (agg29, "SELECT user_id, round(median(value), 6) AS mouth_width, round(avg((event_type = 'view')::INT), 6) AS face_ratio FROM events GROUP BY user_id"),
    "ts04_capped_frames": (ts04, "SELECT event_id FROM (SELECT event_id, epoch(ts) AS t_s, min(epoch(ts)) OVER (PARTITION BY user_id) AS t_first FROM events) WHERE t_s <= t_first + 20 * 86400.0"),
    "ts05_speech_spans": (ts05, "WITH s AS (SELECT user_id, CAST(floor(value) AS BIGINT) * 100 - 500 AS a, CAST(floor(value) AS BIGINT) * 100 - 500 + event_id % 3 * 400 AS b FROM events), c AS (SELECT user_id, greatest(0, a) AS a, least(5000, b) AS b FROM s) SELECT user_id, round(sum(b - a) / 16000.0, 6) AS seconds, min(a) AS first, max(b) AS last FROM c WHERE a < b GROUP BY user_id"),
    "agg38_nbest_oracle": (agg38, _RANKED + ", b AS (SELECT sample_id, min(errors) AS best FROM ranked WHERE rank % 2 = 0 GROUP BY 1), s AS (SELECT conv_id AS sample_id, length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS characters FROM conversations WHERE turn = 0) SELECT 'c' || (s.sample_id % 3) AS config, round(sum(coalesce(best, characters)) / sum(characters), 6) AS cer FROM s LEFT JOIN b ON s.sample_id = b.sample_id GROUP BY 1"),
    "set12_already_in_manifest": (set12, "SELECT doc_id FROM documents d WHERE lang = 'en' AND (EXISTS (SELECT 1 FROM documents e WHERE e.lang <> 'en' AND e.text = d.text) OR EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text))"),
    "sc15_candidates_disagree": (sc15, _RANKED + r", t AS (SELECT sample_id, rank, regexp_replace(text, '[\s\p{P}]', '', 'g') AS t FROM ranked WHERE NOT regexp_full_match(text, '\s*')), d AS (SELECT sample_id, t, min(rank) AS rank FROM t GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS place, first_value(t) OVER (PARTITION BY sample_id ORDER BY rank) AS top FROM d) SELECT r.sample_id, coalesce(bool_or(place > 1 AND levenshtein(t, top) / greatest(length(t), length(top), 1) > 0.38), false) AS disagree FROM (SELECT DISTINCT sample_id FROM ranked) r LEFT JOIN p ON p.sample_id = r.sample_id AND place <= 3 GROUP BY 1"),
    "sc10_unsupported_units": (sc10, "WITH u AS (SELECT doc_id AS id, " + _UNITS.replace("nfkc", "text") + " AS u FROM documents), k AS (SELECT DISTINCT unnest(" + _UNITS.replace("nfkc", "text") + ") AS unit FROM benchmark), o AS (SELECT DISTINCT id, unnest(u) AS unit FROM u UNION SELECT id, NULL FROM u WHERE u IS NULL OR len(u) = 0) SELECT id, unit FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.unit = o.unit)"),
}
