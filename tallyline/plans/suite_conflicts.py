"""Queries of the violation checks, and their SQL. Parts stand in for configurations, events and documents for reports and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts
from . import stand_ins
from .suite_sequences import _RANKED, ranked

S, D = SparkSession, DataFrame


def _rows(spark: S, sf: str, name: str, **columns: str) -> D:
    return stand_ins.table(spark, sf, name).selectExpr(*[f"{x} AS {k}" for k, x in columns.items()])


_CONFIG = {"id": "p_partkey - CAST(p_partkey % 9 = 0 AS INT)", "split": "CASE WHEN p_partkey % 5 = 0 THEN 'test' WHEN p_partkey % 5 = 1 THEN 'val' ELSE 'dev' END", "label_verified": "p_partkey % 7 <> 0", "label_source": "CASE WHEN p_partkey % 11 <> 0 THEN p_brand ELSE '' END", "reverse_weight": "p_retailprice / 1800", "weight": "p_retailprice / 1500", "beam": "p_size", "nbest": "p_partkey % 30"}
_DOC = {"id": "doc_id", "split": "CASE WHEN lang = 'en' THEN 'dev' ELSE 'test' END", "content": "md5(text)"}
_PROOF = {"id": "event_id - CAST(event_id % 23 = 0 AS INT)", "same_top": "event_id % 7 <> 0", "same_order": "event_id % 11 <> 0", "one": "value", "many": "value + event_id % 5 / 4000.0"}
_TAKE = {"id": "event_id", "speaker": "user_id", "session": "CAST(floor(value) AS BIGINT)", "date": "substr(CAST(ts AS STRING), 1, 10)", "reference": "concat(CASE WHEN event_id % 2 = 0 THEN 'Take ' ELSE 'take, ' END, event_id % 500)", "split": "CASE WHEN user_id % 4 = 0 THEN event_type ELSE 'train' END"}
_LEFT = {"id": "doc_id", "original": "md5(text)", "shape": "n_chars", "seed": "doc_id % 7", "preset": "lang", "output": "md5(concat(text, lang))", "failed": "doc_id % 10 = 0"}
_RIGHT = _LEFT | {"original": "md5(concat(text, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END))", "preset": "CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'other' END", "output": "md5(concat(text, CASE WHEN doc_id % 3 = 0 THEN 'y' ELSE lang END))", "failed": "doc_id % 13 = 0"}


def _sql(table: str, columns: dict[str, str], where: str = "true") -> str:
    return "SELECT " + ", ".join(f'{x.replace("AS STRING", "AS VARCHAR")} AS "{k}"' for k, x in columns.items()) + f" FROM {table} WHERE {where}"


def _listed(rows: str, checks: dict[str, str]) -> str:
    return " UNION ".join(f"SELECT id, '{name}' AS issue FROM {rows} WHERE {bad}" for name, bad in checks.items())


def val08(spark: S, sf: str) -> D:
    return conflicts.protocol_issues(_rows(spark, sf, "part", **_CONFIG))


def val09(spark: S, sf: str) -> D:
    fits = conflicts.search_fits(F.col("p_size"), F.col("p_partkey") % 30, F.col("p_partkey") % 4, F.col("p_retailprice") / 500)
    return stand_ins.table(spark, sf, "part").where(~fits).select("p_partkey")


def val11(spark: S, sf: str) -> D:
    return stand_ins.table(spark, sf, "documents").select("doc_id", conflicts.visual_seed(F.col("doc_id").cast("string"), 4_000_000_000).alias("seed"))


def val12(spark: S, sf: str) -> D:
    reports = stand_ins.table(spark, sf, "conversations").where("turn = 1 + conv_id % 2").select(F.col("conv_id").alias("sample_id"), F.col("text").alias("raw"))
    return conflicts.first_hypothesis(reports, ranked(spark, sf))


def val17(spark: S, sf: str) -> D:
    d = _rows(spark, sf, "documents", **_DOC)
    return conflicts.selection_leaks(d.where("split = 'dev' OR id % 50 = 0"), d.where("split = 'test'"))


def val18(spark: S, sf: str) -> D:
    e = stand_ins.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    after = e.where("event_id % 17 <> 0").withColumn("user_id", F.col("user_id") + (F.col("event_id") % 19 == 0).cast("int"))
    return conflicts.changed_samples(e.where("event_id % 13 <> 0"), after, "event_id", ["user_id", "event_type"])


def val19(spark: S, sf: str) -> D:
    return conflicts.parity_failures(_rows(spark, sf, "events", **_PROOF), ["same_top", "same_order"], "one", "many")


def jn12(spark: S, sf: str) -> D:
    takes = _rows(spark, sf, "events", **_TAKE)
    return conflicts.sibling_conflicts(takes.where("id % 3 <> 0"), takes.where("id % 3 = 0"))


def jn19(spark: S, sf: str) -> D:
    return conflicts.paired_pixels(_rows(spark, sf, "documents", **_LEFT).where("id % 17 <> 0"), _rows(spark, sf, "documents", **_RIGHT).where("id % 19 <> 0"))


def agg32(spark: S, sf: str) -> D:
    steps = _rows(spark, sf, "events", epoch="user_id % 10", loss="value", part="value * 0.3")
    return conflicts.epoch_means(steps, "epoch", ["loss", "part"]).select("epoch", F.round("loss", 6).alias("loss"), F.round("part", 6).alias("part"))


_OTHER = "SELECT DISTINCT n.id, '{flag}' AS issue FROM t n WHERE n.id % 3 <> 0 AND EXISTS (SELECT 1 FROM t s WHERE s.id % 3 = 0 AND {on} AND s.{value} <> n.{value})"

QUERIES = {
    "val08_decoder_protocol": (val08, "WITH r AS (" + _sql("part", _CONFIG) + ") " + _listed("r", {"split": "split NOT IN ('dev', 'val', 'validation')", "label": "NOT label_verified OR label_source = ''", "reverse weight": "NOT reverse_weight BETWEEN 0 AND 1", "repeated id": "id IN (SELECT id FROM r GROUP BY id HAVING count(*) > 1)", "repeated weight": "weight IN (SELECT weight FROM r GROUP BY weight HAVING count(*) > 1)", "weight": "NOT (weight > 0 AND weight <= 1)", "beam": "NOT (beam >= nbest AND nbest >= 1)"})),
    "val09_search_parameters": (val09, "SELECT p_partkey FROM part WHERE NOT (p_size >= p_partkey % 30 AND p_partkey % 30 >= p_partkey % 4 AND p_partkey % 4 >= 1 AND p_retailprice / 500 BETWEEN 1 AND 4)"),
    "val11_visual_seeds": (val11, "SELECT doc_id, (CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 9, 8) AS BIGINT) + 4000000000) % 4294967296 AS seed FROM documents"),
    "val12_first_hypothesis": (val12, _RANKED + ", b AS (SELECT sample_id, arg_min(text, rank) AS first FROM ranked GROUP BY 1) SELECT conv_id AS sample_id, 'text' AS issue FROM conversations LEFT JOIN b ON conv_id = sample_id WHERE turn = 1 + conv_id % 2 AND first IS DISTINCT FROM text"),
    "val17_selection_leaks": (val17, "WITH d AS (" + _sql("documents", _DOC) + "), s AS (SELECT * FROM d WHERE split = 'dev' OR id % 50 = 0), t AS (SELECT * FROM d WHERE split = 'test') " + _listed("s", {"split": "split <> 'dev'", "repeated id": "id IN (SELECT id FROM s GROUP BY id HAVING count(*) > 1)", "id in test": "id IN (SELECT id FROM t)", "content in test": "content IN (SELECT content FROM t)"})),
    "val18_changed_samples": (val18, "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'missing' WHEN event_id % 13 = 0 THEN 'unexpected' ELSE 'changed' END AS issue FROM events WHERE (event_id % 17 = 0) <> (event_id % 13 = 0) OR event_id % 19 = 0 AND event_id % 17 <> 0"),
    "val19_parity_failures": (val19, "WITH r AS (" + _sql("events", _PROOF) + ") " + _listed("r", {"same_top": "NOT same_top", "same_order": "NOT same_order", "scores": "NOT abs(one - many) < 1e-3", "repeated id": "id IN (SELECT id FROM r GROUP BY id HAVING count(*) > 1)"})),
    "jn12_sibling_conflicts": (jn12, "WITH t AS (" + _sql("events", _TAKE) + ") " + " UNION ".join(_OTHER.format(flag=f, on=on, value=v) for f, on, v in (("speaker", "s.speaker = n.speaker", "split"), ("date", "s.speaker = n.speaker AND s.session = n.session", "date"), ("reference", "regexp_replace(lower(s.reference), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n.reference), '[^a-z0-9]', '', 'g')", "split")))),
    "jn19_paired_pixels": (jn19, "WITH a AS (" + _sql("documents", _LEFT, "doc_id % 17 <> 0") + "), b AS (" + _sql("documents", _RIGHT, "doc_id % 19 <> 0") + ") SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'missing' WHEN a.failed OR b.failed THEN 'failed' WHEN a.original <> b.original OR a.shape <> b.shape OR a.seed <> b.seed THEN 'original' WHEN a.preset = b.preset AND a.output <> b.output THEN 'output' WHEN a.preset <> b.preset THEN 'preprocessing' ELSE 'same' END AS status FROM a FULL JOIN b ON a.id = b.id"),
    "agg32_epoch_means": (agg32, "SELECT user_id % 10 AS epoch, round(avg(value), 6) AS loss, round(avg(value * 0.3), 6) AS part FROM events GROUP BY 1"),
}
