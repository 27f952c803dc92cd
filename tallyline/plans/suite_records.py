"""Queries of recognised tokens, runs and document checks, and their SQL. Documents are JSON made of the supplied columns by one expression for both."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_key
from ..operators import recognition, records, timeseries
from . import stand_ins
from .suite_conflicts import _listed, _rows, _sql

S, D = SparkSession, DataFrame

LETTERS = "abcdefghijklmnopqrstuvwxyz"
VOCABULARY = ["<blank>", "▁a", "b", "c", "<space>", "d", "<eos>"]


def flt19(spark: S, sf: str) -> D:
    """Five hypotheses to an utterance, of up to three of five tokens: some repeat, some lack their start, hold a blank, end twice, are forced or have no score."""
    e = stand_ins.table(spark, sf, "embeddings")
    i = F.col("vec_id")
    body = F.slice(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when((i % 97 == 0) & (k == 0), 0).otherwise((F.floor(i / 5) * 7 + i % 3 * (k + 1)) % 5 + 1).cast("int")), F.lit(1), (i % 4).cast("int"))
    end = F.array(F.lit(6))
    tokens = F.concat(F.when(i % 89 == 0, F.slice(end, 1, 0)).otherwise(end), body, end, F.when(i % 11 == 0, end).otherwise(F.slice(end, 1, 0)))
    score = F.when(i % 83 == 0, float("nan")).otherwise(-(i % 50) / 4)
    beams = e.select(F.floor(i / 5).alias("utterance"), (i % 5).alias("place"), tokens.alias("tokens"), score.alias("score"), F.lit(None).cast("double").alias("forward"), (-(i % 7) / 2).alias("ctc"), (F.floor(i / 5) % 6 + 1).alias("frames"))
    return recognition.beam_candidates(beams, VOCABULARY, 3).withColumn("tokens", F.array_join("tokens", ","))


def _token_rows(spark: S, sf: str) -> D:
    """References and what was recognised as ids of letters; every third recognised id stands twice, every fifth has a blank behind it; odd conversations are padded."""
    pairs = stand_ins.samples(spark, sf).join(stand_ins.predictions(spark, sf), "sample_id")
    ids = lambda c: F.transform(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z ]", ""), ""), lambda x: x != ""), lambda x: F.instr(F.lit(LETTERS + " "), x))
    heard = F.flatten(F.transform(ids(F.col("raw")), lambda x, i: F.concat(F.array(x), F.when(i % 3 == 0, F.array(x)).otherwise(F.slice(F.array(x), 1, 0)), F.when(i % 5 == 0, F.array(F.lit(0))).otherwise(F.slice(F.array(x), 1, 0)))))
    known = ids(F.col("reference"))
    return pairs.select("speaker", heard.alias("hyp"), F.when(F.col("conv_id") % 2 == 1, F.concat(known, F.array(F.lit(-1), F.lit(-1)))).otherwise(known).alias("ref"))


def _rates(spark: S, sf: str) -> D:
    return recognition.token_rates(_token_rows(spark, sf), ["<blank>", *LETTERS, "<space>", "<eos>"], "<space>", "<blank>", "speaker")


def agg25(spark: S, sf: str) -> D:
    return _rates(spark, sf).select("speaker", F.round("cer", 9).alias("cer"), F.round("cer_ctc", 9).alias("cer_ctc"))


def agg25w(spark: S, sf: str) -> D:
    return _rates(spark, sf).select("speaker", F.round("wer", 9).alias("wer"))


def _runs(spark: S, sf: str) -> D:
    """Two runs of each sample: the stand-in, and one that recognises every third conversation and fails in none."""
    pairs = stand_ins.samples(spark, sf).join(stand_ins.predictions(spark, sf), "sample_id")
    better = F.when(F.col("conv_id") % 3 == 0, F.col("reference")).otherwise(F.col("raw"))
    both = F.array(F.struct(F.lit("base").alias("run"), F.col("raw").alias("raw"), F.when(F.col("conv_id") % 40 < 20, F.col("error")).alias("error")), F.struct(F.lit("new").alias("run"), better.alias("raw"), F.lit("").alias("error")))
    return pairs.select("speaker", "domain", "reference", "action", F.explode(both).alias("x")).select("speaker", "domain", "reference", "action", "x.*")


def _summaries(spark: S, sf: str, by: str) -> D:
    return recognition.run_summary(_runs(spark, sf), by, "run", key=ascii_key)


def agg26(spark: S, sf: str) -> D:
    got = _summaries(spark, sf, "speaker")
    return got.select("speaker", "run", "samples", "errors", "characters", "failures", *(F.round(c, 9).alias(c) for c in ("cer", "exact_rate", "coverage")))


def srt14(spark: S, sf: str) -> D:
    return recognition.improvements_over(_summaries(spark, sf, "speaker"), "run", "base", "speaker")


def agg27(spark: S, sf: str) -> D:
    rows = _runs(spark, sf).where("run = 'base'")
    key = lambda c: ascii_key(F.col(c))
    scored = rows.select("domain", "error", F.levenshtein(key("raw"), key("reference")).alias("errors"), F.length(key("reference")).alias("characters"), (key("raw") == key("reference")).alias("exact"))
    return recognition.transform_summary(scored, "domain").withColumn("cer", F.round("cer", 9))


def agg34(spark: S, sf: str) -> D:
    t = stand_ins.table(spark, sf, "conversations")
    chances = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: 1.0 / F.length(w))
    return t.select("conv_id", "turn", F.round(recognition.mean_probability(F.when(F.col("turn") % 9 != 0, chances).otherwise(F.array().cast("array<double>"))), 9).alias("probability"))


_RESULTS = "SELECT user_id % 20 AS experiment, event_id // 2 % 3 AS ord, event_id % 2 AS condition, sum(CAST(floor(value) AS BIGINT) % 7 + CASE WHEN event_id // 2 % 3 = 0 THEN 1 ELSE 0 END) AS errors, count(*) * 20 AS characters, sum(CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 OR event_id // 2 % 3 > 0 AND event_id % 5 < 3 THEN 1 ELSE 0 END) AS exact, sum(CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 OR event_id // 2 % 3 > 0 AND event_id % 7 < 3 THEN 1 ELSE 0 END) AS coverage, sum(CASE WHEN event_id % 499 = 0 THEN 1 ELSE 0 END) AS failures FROM events GROUP BY 1, 2, 3"


def srt13(spark: S, sf: str) -> D:
    """A user's events under three presets and two conditions."""
    rows = spark.sql(_RESULTS.replace(" // ", " DIV ").replace("FROM events", "FROM {events}"), events=stand_ins.table(spark, sf, "events"))
    named = rows.withColumns({"preset": F.element_at(F.array(*map(F.lit, records.PRESETS)), (F.col("ord") + 1).cast("int")), "condition": F.when(F.col("condition") == 0, "clean").otherwise("stress")})
    return recognition.preset_checks(named, "identity", "clean")


def ts03(spark: S, sf: str) -> D:
    e = stand_ins.table(spark, sf, "embeddings").withColumn("wave", timeseries.layer_normed(F.col("embedding"), F.col("vec_id") % 4 + 2, 16))
    return e.select("vec_id", F.size("wave").alias("n"), F.round(F.element_at("wave", 1), 6).alias("first"), F.round(F.element_at("wave", -1), 6).alias("last"))


_H = "concat(md5({0}), md5({0}))"
_SIDECAR = {
    "id": "doc_id", "domain": "CASE WHEN doc_id % 3 = 0 THEN 'webcam' WHEN doc_id % 3 = 1 THEN 'mouth_roi' END", "known": "doc_id % 17 <> 0",
    "record": "concat(CASE WHEN doc_id % 41 = 0 THEN '[' ELSE '{' END, '\"provenance\": ', CASE WHEN doc_id % 7 = 0 THEN '\" \"' WHEN doc_id % 23 = 0 THEN '5' ELSE concat('\"', lang, '\"') END, ', \"metadata_verified\": ', CASE WHEN doc_id % 11 = 0 THEN '\"true\"' ELSE 'true' END, "
    "CASE WHEN doc_id % 5 = 0 THEN ', \"capture_type\": \"real_webcam\"' WHEN doc_id % 5 = 1 THEN ', \"capture_type\": \"pre_cropped\"' WHEN doc_id % 5 = 2 THEN ', \"capture_type\": null' ELSE '' END, CASE WHEN doc_id % 13 = 0 THEN ', \"content_style\": \"sung\"' ELSE '' END, CASE WHEN doc_id % 19 = 0 THEN ', \"scene\": \"\"' ELSE '' END, CASE WHEN doc_id % 29 = 0 THEN ', \"mood\": 1' ELSE '' END, '}')"}  # fmt: skip


def val07(spark: S, sf: str) -> D:
    rows = _rows(spark, sf, "documents", **_SIDECAR)
    return records.sidecar_issues(rows.select("id", "record"), rows.where("known").select("id", "domain"))



def _hashed(of: str, text: str) -> str:
    """``text`` with a digest of ``of`` for each H."""
    return re.sub(r"\bH\b", _H.format(of), text)


_MODEL = {
    "id": "p_partkey",
    "model": _hashed("CAST(p_size % 5 AS STRING)", "concat('{\"name\": \"', CASE WHEN p_partkey % 31 = 0 THEN '  ' ELSE 'reader' END, '\", \"encoder_device\": \"cpu\", \"decoder_device\": ', CASE WHEN p_partkey % 37 = 0 THEN 'null' ELSE '\"cpu\"' END, ', \"language\": \"', CASE WHEN p_partkey % 13 = 0 THEN 'en' ELSE 'zh' END, "
    "'\", \"checkpoint_sha256\": ', CASE WHEN p_partkey % 7 = 0 THEN 'null' WHEN p_partkey % 17 = 0 THEN '\"0\"' ELSE concat('\"', H, '\"') END, ', \"configuration_sha256\": \"', H, '\", \"vocabulary_sha256\": \"', CASE WHEN p_partkey % 43 = 0 THEN upper(H) ELSE H END, '\"', "
    "CASE WHEN p_partkey % 3 = 0 THEN ', \"adapter\": null' WHEN p_partkey % 19 = 0 THEN '' ELSE concat(', \"adapter\": {\"file_sha256\": \"', H, '\", \"base_checkpoint_sha256\": \"', H, '\", \"schema_version\": ', CASE WHEN p_partkey % 47 = 0 THEN 'true' ELSE '1' END, ', \"language\": \"zh\"}') END, "
    "', \"beam_size\": ', p_size % 3 + 1, ', \"nbest\": ', p_size % 4 + 1, CASE WHEN p_partkey % 2 = 0 THEN concat(', \"candidate_pool_size\": ', p_size % 4 + 1) ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ', \"pre_beam_ratio\": 1.5' WHEN p_partkey % 53 = 0 THEN ', \"pre_beam_ratio\": 5' ELSE '' END, "
    "', \"ctc_weight\": ', CASE WHEN p_partkey % 23 = 0 THEN '1.25' WHEN p_partkey % 2 = 0 THEN '0.5' ELSE '0.50' END, ', \"reverse_weight\": 1, \"length_bonus\": ', CASE WHEN p_partkey % 29 = 0 THEN '\"0\"' ELSE '0' END, ', \"external_lm\": false, \"personal\": ', CASE WHEN p_partkey % 11 = 0 THEN '0' ELSE 'false' END, "
    "CASE WHEN p_partkey % 59 = 0 THEN ', \"decoder_weights\": {}' ELSE '' END, CASE WHEN p_partkey % 3 = 1 THEN ', \"reverse_tie_tolerance\": 1e-3' ELSE '' END, '}')")}  # fmt: skip
_POOLED = "p_size % 3 + 1 >= p_size % 4 + 1"


def _models(spark: S, sf: str) -> D:
    """A part's row is some bytes, its document and its checks are not: rows are dealt first, as a small file would be one task.

    The number of partitions is named, as Spark puts small ones together again else."""
    dealt = stand_ins.table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return dealt.selectExpr(*[f"{x} AS {k}" for k, x in _MODEL.items()])


def val10(spark: S, sf: str) -> D:
    return records.provenance_issues(_models(spark, sf), "zh")


def sc46(spark: S, sf: str) -> D:
    """How many reports share a binding, of those whose provenance is whole."""
    rows = _models(spark, sf).select("id", records.comparable_binding(F.col("model"), "zh").alias("binding"))
    # filtered behind the sums: Spark would move a filter on the binding, with all that makes it, in front of the dealing
    return rows.groupBy("binding").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.count("binding").alias("whole")).where("whole > 0").select("first_id", "n")


_FROZEN = {
    "id": "p_partkey",
    "document": _hashed("p_name", "concat('{\"schema_version\": ', CASE WHEN p_partkey % 7 = 0 THEN '2' ELSE '1' END, ', \"selection_partition\": \"', CASE WHEN p_partkey % 11 = 0 THEN 'test' ELSE 'dev' END, '\"', CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN ', \"test_used_for_selection\": \"false\"' WHEN p_partkey % 19 = 0 THEN ', \"test_used_for_selection\": true' ELSE ', \"test_used_for_selection\": false' END, "
    "', \"selected_preprocessing\": \"', CASE WHEN p_partkey % 23 = 0 THEN 'sharpen' ELSE 'identity' END, '\"', CASE WHEN p_partkey % 5 = 0 THEN concat(', \"provenance\": {\"dev_report_sha256\": {\"a.json\": \"', H, '\"', CASE WHEN p_partkey % 3 = 0 THEN ', \"b.json\": 5' ELSE '' END, '}}') WHEN p_partkey % 5 = 1 THEN ', \"provenance\": {\"dev_report_sha256\": {}}' WHEN p_partkey % 29 = 0 THEN ', \"provenance\": 5' ELSE '' END, "
    "CASE WHEN p_partkey % 4 <> 0 THEN concat(', \"input_sha256\": {\"c.json\": \"', CASE WHEN p_partkey % 31 = 0 THEN 'x' ELSE '' END, H, '\"}') ELSE '' END, '}')")}  # fmt: skip


def val22(spark: S, sf: str) -> D:
    return records.selection_issues(_rows(spark, sf, "part", **_FROZEN))


_PICTURE = {
    "id": "doc_id", "error": "CASE WHEN doc_id % 5 = 0 THEN 'no face' END", "configuration": "CASE WHEN doc_id % 10 = 0 OR doc_id % 47 = 0 THEN NULL WHEN doc_id % 41 = 0 THEN 'other' ELSE 'mild' END", "original": _H.format("text"),
    "input": "CASE WHEN doc_id % 43 = 0 THEN md5(text) ELSE " + _H.format("text") + " END", "shape": "ARRAY[coalesce(n_chars, 0), 96, CASE WHEN doc_id % 37 = 0 THEN 0 ELSE 3 END]", "dtype": "CASE WHEN doc_id % 53 = 0 THEN 'float32' ELSE 'uint8' END"}
_OTHER = _PICTURE | {"error": "''", "configuration": "CASE WHEN doc_id % 20 = 0 THEN NULL ELSE 'identity' END", "original": _H.format("concat(text, CASE WHEN doc_id % 31 = 0 THEN 'x' ELSE '' END)")}


def _pictures(spark: S, sf: str, columns: dict[str, str]) -> D:
    own = {k: v.replace("ARRAY[", "array(").replace("]", ")") for k, v in columns.items()}
    off = (F.col("id") % 59 == 0).cast("int")
    return _rows(spark, sf, "documents", **own).withColumn("seed", records.visual_seed(F.col("id").cast("string"), 7) + off)


def jn20(spark: S, sf: str) -> D:
    return records.picture_issues(_pictures(spark, sf, _PICTURE).where("id % 61 <> 0"), _pictures(spark, sf, _OTHER).where("id % 67 <> 0"), (7, 7), ("mild", "identity"))


def val24(spark: S, sf: str) -> D:
    """Documents as parameters of their language's model: lengths as sizes."""
    rows = stand_ins.table(spark, sf, "documents").selectExpr("lang AS model", "doc_id AS name", "n_chars AS size")
    n = F.col("name")
    want = rows.where(n % 29 != 0).select("model", "name", F.array("size", F.lit(3)).alias("shape"), F.lit("f4").alias("dtype"))
    twice = F.explode(F.when(n % 47 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    have = rows.where(n % 31 != 0).select("model", "name", F.array(F.col("size") + (n % 37 == 0).cast("int"), F.lit(3)).alias("shape"), F.when(n % 41 == 0, "f2").otherwise("f4").alias("dtype"), (n % 43 != 0).alias("finite"), twice.alias("_")).drop("_")
    return records.parameter_issues(want, have)


_BEAMS = """WITH e AS (SELECT vec_id AS i, vec_id // 5 AS utterance, vec_id % 5 AS place, list_transform(range(CAST(vec_id % 4 AS BIGINT)), lambda k: CASE WHEN vec_id % 97 = 0 AND k = 0 THEN 0 ELSE (vec_id // 5 * 7 + vec_id % 3 * (k + 1)) % 5 + 1 END) AS body,
    vec_id % 89 = 0 AS headless, CAST(vec_id % 11 = 0 AS INTEGER) AS extra FROM embeddings), h AS (SELECT *, headless AND NOT (len(body) = 0 AND extra = 1) AS unbounded, len(body) + 2 + extra - CAST(headless AS INTEGER) AS size,
    trim(regexp_replace(regexp_replace(array_to_string(list_transform(body, lambda x: (['<blank>', '▁a', 'b', 'c', '<space>', 'd'])[x + 1]), ''), '▁|<space>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM e),
  s AS (SELECT *, NOT unbounded AND size = utterance % 6 + 3 AS forced, NOT unbounded AND text <> '' AND row_number() OVER (PARTITION BY utterance, CASE WHEN unbounded THEN NULL ELSE text END ORDER BY place) = 1 AS fresh FROM h),
  m AS (SELECT *, CASE WHEN unbounded THEN 'boundary' WHEN list_contains(body, 0) THEN 'token' WHEN fresh AND i % 83 = 0 THEN 'evidence' END AS own FROM s),
  w AS (SELECT *, min(CASE WHEN own IS NOT NULL THEN place END) OVER (PARTITION BY utterance) AS bad, bool_or(forced) OVER (PARTITION BY utterance) AS skip_, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY utterance ORDER BY place) AS rank_ FROM m)
  SELECT utterance, CAST(rank_ AS INTEGER) AS rank, text, array_to_string(body, ',') AS tokens, -(i % 50) / 4 AS score, forced, CAST(1 + extra - CAST(headless AS INTEGER) AS INTEGER) AS trailing, skip_ AS skip, NULL AS issue FROM w WHERE bad IS NULL AND fresh AND rank_ <= 3
  UNION ALL SELECT utterance, NULL, NULL, NULL, NULL, NULL, NULL, NULL, own FROM w WHERE place = bad"""
_TOKENS = "WITH " + stand_ins.SAMPLES_SQL + """, ids AS (SELECT s.speaker, list_transform(list_filter(string_split(regexp_replace(lower(p.raw), '[^a-z ]', '', 'g'), ''), lambda x: x <> ''), lambda x: instr('abcdefghijklmnopqrstuvwxyz ', x)) AS h, list_transform(list_filter(string_split(regexp_replace(lower(s.reference), '[^a-z ]', '', 'g'), ''), lambda x: x <> ''), lambda x: instr('abcdefghijklmnopqrstuvwxyz ', x)) AS r FROM samples s JOIN predictions p USING (sample_id)),
  heard AS (SELECT speaker, r, flatten(list_transform(h, lambda x, i: list_concat([x], CASE WHEN (i - 1) % 3 = 0 THEN [x] ELSE [] END, CASE WHEN (i - 1) % 5 = 0 THEN [0] ELSE [] END))) AS h FROM ids),
  spelled AS (SELECT speaker, array_to_string(list_transform(list_filter(h[1:len(r)], lambda x: x BETWEEN 1 AND 26), lambda x: chr(CAST(96 + x AS INTEGER))), '') AS hc, array_to_string(list_transform(list_filter(r, lambda x: x < 27), lambda x: chr(CAST(96 + x AS INTEGER))), '') AS rc,
    array_to_string(list_transform(list_filter(list_filter(h, lambda x, i: i = 1 OR x <> h[i - 1]), lambda x: x BETWEEN 1 AND 26), lambda x: chr(CAST(96 + x AS INTEGER))), '') AS ch FROM heard)
  SELECT speaker, round(sum(levenshtein(hc, rc)) / sum(length(rc)), 9) AS cer, round(sum(levenshtein(ch, rc)) FILTER (rc <> '') / sum(length(rc)), 9) AS cer_ctc FROM spelled GROUP BY 1"""
_RUNS = "WITH " + stand_ins.SAMPLES_SQL + """, pairs AS (SELECT s.*, p.raw, p.action, p.error FROM samples s JOIN predictions p USING (sample_id)),
  runs AS (SELECT speaker, domain, reference, action, 'base' AS run, raw, CASE WHEN conv_id % 40 < 20 THEN error END AS error FROM pairs UNION ALL SELECT speaker, domain, reference, action, 'new', CASE WHEN conv_id % 3 = 0 THEN reference ELSE raw END, '' FROM pairs),
  k AS (SELECT *, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS h, regexp_replace(lower(reference), '[^a-z0-9]', '', 'g') AS r FROM runs),
  f AS (SELECT speaker, run, count(*) AS samples, CAST(sum(levenshtein(h, r)) AS BIGINT) AS errors, CAST(sum(length(r)) AS BIGINT) AS characters, count(*) FILTER (h = r) AS exact, count(*) FILTER (h <> '' AND action <> 'retry' AND coalesce(error, '') = '') AS offered, count(*) FILTER (error <> '') AS failures FROM k GROUP BY 1, 2)"""
_CHECKS = "SELECT n.speaker, n.run, '{0}' AS \"check\", {1} AS passed FROM f n JOIN f b ON b.speaker = n.speaker AND b.run = 'base' WHERE n.run = 'new'"
_D = "json_type(record, '$.{0}')"


def _string(doc: str, field: str) -> str:
    return f"CASE WHEN json_type({doc}, '$.{field}') = 'VARCHAR' THEN json_extract_string({doc}, '$.{field}') ELSE '' END"


_HEX = "NOT regexp_full_match(" + "{0}, '[0-9a-f]{{64}}')"

QUERIES = {
    "flt19_beam_candidates": (flt19, _BEAMS),
    "agg25_token_rates": (agg25, _TOKENS),
    "agg25_token_word_rates": (agg25w, None),
    "agg26_run_summary": (agg26, _RUNS + " SELECT speaker, run, samples, errors, characters, failures, round(errors / characters, 9) AS cer, round(exact / samples, 9) AS exact_rate, round(offered / samples, 9) AS coverage FROM f"),
    "srt14_improvement_gate": (srt14, _RUNS + " " + " UNION ALL ".join(_CHECKS.format(*x) for x in (("cer lower", "n.errors / n.characters < b.errors / b.characters"), ("exact not lower", "n.exact >= b.exact"), ("coverage not lower", "n.offered >= b.offered"), ("no failures", "n.failures = 0 AND b.failures = 0")))),
    "agg27_transform_summary": (agg27, _RUNS + " SELECT domain, count(*) AS samples, CAST(sum(levenshtein(h, r)) AS BIGINT) AS errors, CAST(sum(length(r)) AS BIGINT) AS characters, count(*) FILTER (h = r) AS exact, count(*) FILTER (error <> '') AS failures, round(sum(levenshtein(h, r)) / sum(length(r)), 9) AS cer FROM k WHERE run = 'base' GROUP BY 1"),
    "agg34_mean_probability": (agg34, "SELECT conv_id, turn, round(CASE WHEN turn % 9 <> 0 THEN coalesce(list_avg(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: 1.0 / length(w))), 0) ELSE 0 END, 9) AS probability FROM conversations"),
    "srt13_preset_checks": (srt13, "WITH r AS (" + _RESULTS + "), b AS (SELECT * FROM r WHERE ord = 0), w AS (SELECT experiment, count(*) AS conditions, sum(failures) AS failed FROM b GROUP BY 1), g AS (SELECT r.experiment, r.ord, sum(r.errors) AS errors, sum(r.errors) < sum(b.errors) AS pooled_lower, bool_and(coalesce(r.condition = 1 OR r.errors / r.characters <= b.errors / b.characters, false)) AS clean_not_worse, bool_and(coalesce(r.exact >= b.exact, false)) AS exact_not_lower, bool_and(coalesce(r.coverage >= b.coverage, false)) AS coverage_not_lower, sum(r.failures) AS failed, count(*) AS n FROM r LEFT JOIN b ON r.experiment = b.experiment AND r.condition = b.condition WHERE r.ord > 0 GROUP BY 1, 2), j AS (SELECT g.*, g.failed = 0 AND w.failed = 0 AS no_failures, g.n = w.conditions AS whole FROM g JOIN w USING (experiment)), l AS (SELECT *, whole AND pooled_lower AND clean_not_worse AND exact_not_lower AND coverage_not_lower AND no_failures AS eligible FROM j) SELECT experiment, ['identity', 'stabilize_mild', 'stabilize_moderate'][ord + 1] AS preset, CAST(errors AS BIGINT) AS errors, pooled_lower, clean_not_worse, exact_not_lower, coverage_not_lower, no_failures, eligible, eligible AND row_number() OVER (PARTITION BY experiment ORDER BY eligible DESC, errors, ord) = 1 AS selected FROM l"),
    "ts03_layer_normed": (ts03, "WITH p AS (SELECT vec_id, list_transform(list_concat(embedding, list_transform(range(16), lambda i: 0))[1 : (vec_id % 4 + 2) * 16], lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings), m AS (SELECT *, list_avg(w) AS mu, list_var_pop(w) AS v FROM p) SELECT vec_id, CAST(len(w) AS INTEGER) AS n, round((w[1] - mu) / sqrt(v + 1e-5), 6) AS first, round((w[-1] - mu) / sqrt(v + 1e-5), 6) AS last FROM m"),
    "val07_sidecar": (val07, "WITH r AS (SELECT *, coalesce(CASE WHEN known THEN coalesce(domain, 'unknown') END, '-') AS d, json_valid(record) AS fine FROM (" + _sql("documents", _SIDECAR) + ")) " + _listed("r", {
        "record": "NOT fine", "unknown id": "NOT known", "field": "fine AND id % 29 = 0", "provenance": f"fine AND trim({_string('record', 'provenance')}) = ''", "verified": "fine AND " + _D.format("metadata_verified") + " <> 'BOOLEAN'", "scene": f"fine AND {_D.format('scene')} IS NOT NULL AND {_string('record', 'scene')} = ''",
        "capture_type": f"fine AND {_D.format('capture_type')} = 'NULL'", "content_style": f"fine AND {_D.format('content_style')} IS NOT NULL", "webcam": f"fine AND {_string('record', 'capture_type')} = 'real_webcam' AND known AND d <> 'webcam'", "cropped": f"fine AND {_string('record', 'capture_type')} = 'pre_cropped' AND known AND d <> 'mouth_roi'"})),
    "val10_model_provenance": (val10, "WITH r AS (" + _sql("part", _MODEL).replace('AS "model"', 'AS "model", p_size') + ") " + _listed("r", {
        "name": f"trim({_string('model', 'name')}) = ''", "decoder_device": f"{_string('model', 'decoder_device')} = ''", "language": f"{_string('model', 'language')} <> 'zh'", "weights": _HEX.format(_string("model", "checkpoint_sha256")), "vocabulary_sha256": _HEX.format(_string("model", "vocabulary_sha256")),
        "adapter": "json_type(model, '$.adapter') IS NULL OR json_type(model, '$.adapter') = 'OBJECT' AND (json_type(model, '$.adapter.schema_version') = 'BOOLEAN' OR coalesce(json_extract_string(model, '$.adapter.base_checkpoint_sha256') <> json_extract_string(model, '$.checkpoint_sha256'), true))",
        "search": f"NOT {_POOLED}", "ratio": "CAST(json_extract_string(model, '$.pre_beam_ratio') AS DOUBLE) > 4", "ctc_weight": "CAST(json_extract_string(model, '$.ctc_weight') AS DOUBLE) > 1", "length_bonus": "json_type(model, '$.length_bonus') = 'VARCHAR'", "personal": "json_type(model, '$.personal') <> 'BOOLEAN'", "decoder_weights": "json_type(model, '$.decoder_weights') IS NOT NULL"})),
    "sc46_model_bindings": (sc46, f"SELECT min(p_partkey) AS first_id, count(*) AS n FROM part WHERE p_partkey % 31 <> 0 AND p_partkey % 37 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 43 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 19 <> 0 AND p_partkey % 47 <> 0) AND {_POOLED} AND (p_partkey % 5 = 0 OR p_partkey % 53 <> 0) AND p_partkey % 23 <> 0 AND p_partkey % 29 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 59 <> 0 GROUP BY p_size % 5, p_size % 3, p_size % 4, p_partkey % 3 = 0"),
    "val22_frozen_selection": (val22, "WITH r AS (" + _sql("part", _FROZEN) + ") " + _listed("r", {
        "schema": "id % 7 = 0", "partition": "id % 11 = 0", "test used": "id % 13 = 0 OR id % 17 = 0 OR id % 19 = 0", "preset": "id % 23 = 0", "reports": "CASE WHEN id % 5 = 0 THEN id % 3 = 0 WHEN id % 5 <> 1 AND id % 29 = 0 THEN true ELSE id % 4 = 0 OR id % 31 = 0 END"})),
    "jn20_paired_pictures": (jn20, "WITH a AS (" + _sql("documents", _PICTURE, "doc_id % 61 <> 0") + "), b AS (" + _sql("documents", _OTHER, "doc_id % 67 <> 0") + "), j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NOT NULL AS l, b.id IS NOT NULL AS r, coalesce(a.error, '') AS le, a.configuration AS lc, b.configuration AS rc, a.original AS lo, b.original AS ro, coalesce(a.input, b.input) AS input, coalesce(a.shape, b.shape) AS shape, coalesce(a.dtype, b.dtype) AS dtype FROM a FULL JOIN b ON a.id = b.id) " + _listed("j", {
        "unpaired": "NOT l OR NOT r", "a evidence": "l AND CASE WHEN lc IS NULL THEN le = '' ELSE lc <> 'mild' END", "b evidence": "r AND rc IS NULL", "a digest": "lc IS NOT NULL AND coalesce(length(input), 0) <> 64", "b digest": "rc IS NOT NULL AND coalesce(length(input), 0) <> 64",
        "a shape": "lc IS NOT NULL AND (shape[1] <= 0 OR shape[3] <= 0 OR dtype <> 'uint8')", "b shape": "rc IS NOT NULL AND (shape[1] <= 0 OR shape[3] <= 0 OR dtype <> 'uint8')", "a seed": "lc IS NOT NULL AND id % 59 = 0", "b seed": "rc IS NOT NULL AND id % 59 = 0", "different": "lc IS NOT NULL AND rc IS NOT NULL AND lo IS DISTINCT FROM ro"})),
    "val24_parameters": (val24, "WITH r AS (SELECT lang AS model, doc_id AS name, doc_id % 29 <> 0 AS w, doc_id % 31 <> 0 AS h, doc_id AS i FROM documents) " + " UNION ALL ".join(f"SELECT model, name, '{k}' AS issue FROM r WHERE {v}" for k, v in {"missing": "w AND NOT h", "unexpected": "h AND NOT w", "repeated": "h AND i % 47 = 0", "shape": "w AND h AND i % 37 = 0", "type": "w AND h AND i % 41 = 0", "not finite": "h AND i % 43 = 0"}.items())),
}
