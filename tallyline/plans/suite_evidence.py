"""Queries over sidecars, vocabularies, entities, hypotheses, budgets, assets and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edit
from ..operators import evidence, reranking, sampling, scoring, timeseries, validation
from . import stand_ins
from .stand_ins import table
from .suite_comparison import _B, pairs
from .suite_scoring import WITH, _rounded, rated
from .suite_text import _TURNS, _WORDS, turns

D = DataFrame
S = SparkSession


def jn05(spark: S, sf: str) -> D:
    return evidence.uncovered(stand_ins.samples(spark, sf), stand_ins.predictions(spark, sf))


def jn06(spark: S, sf: str) -> D:
    side = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("toxic") == 1, "bad").alias("scene"), F.col("quality").cast("string").alias("grade"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    return evidence.with_sidecar(docs, side, {"scene": "unknown", "grade": "unannotated"})


def jn11(spark: S, sf: str) -> D:
    d = table(spark, sf, "documents").select(F.md5("text").alias("text"), F.concat("lang", F.lit("-"), F.substring("source", 4, 1)).alias("group"), F.when(F.substring("source", 4, 9).cast("int") < 10, "train").otherwise("dev").alias("role"))
    return evidence.shared_across(d, ["text", "group"], "role")


def jn14(spark: S, sf: str) -> D:
    """Order lines as chunks on a clock of 50 frames."""
    li = table(spark, sf, "lineitem")
    chunks = li.select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("long").alias("chunk"), F.col("l_quantity").cast("double").alias("t0"), (F.col("l_linenumber") * 3.0).alias("seconds"), F.col("l_linenumber").cast("double").alias("value"))
    targets = table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"), F.lit(5.0).alias("start"), F.lit(40).alias("n"))
    got = timeseries.placed_chunks(chunks, targets, 1.0)
    return got.where("value is not null").select("clip_id", F.col("k").cast("long").alias("k"), "value")


def jn21(spark: S, sf: str) -> D:
    t = reranking.tokens(table(spark, sf, "conversations").where("role = 'assistant'"), "conv_id", "text")
    v = reranking.tokens(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "text")
    return _rounded(evidence.vocabulary_coverage(t, v))


def jn22(spark: S, sf: str) -> D:
    costs = stand_ins.samples(spark, sf).where("domain = 'webcam'").select("sample_id", (F.col("duration_seconds") / 10).alias("seconds"))
    return _rounded(evidence.charged(rated(spark, sf), costs).groupBy("domain").agg(F.percentile("processing_seconds", 0.95).alias("p95")))


def agg03(spark: S, sf: str) -> D:
    """Equal prices are counted first: a flag's task reads each distinct price once, not once from each task before."""
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count("*").alias("n"))
    return _rounded(counts.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.95, F.col("n")).alias("p95"), F.percentile("l_extendedprice", 0.5, F.col("n")).alias("p50")))


def agg09(spark: S, sf: str) -> D:
    rows = rated(spark, sf).withColumn("alignment", edit.alignment("ref_key", "hyp_key"))
    return _rounded(evidence.sdi_metrics(rows, "domain").select("domain", "samples", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"), "length_ratio", "mean_reference"))


def agg15(spark: S, sf: str) -> D:
    kinds = F.array_compact(F.array(F.when(F.contains("ref_key", F.lit("the")), F.lit("number")), F.when(F.contains("ref_key", F.lit("and")), F.lit("person_name"))))
    return _rounded(evidence.entity_cohorts(rated(spark, sf).withColumn("entities", F.transform(kinds, lambda k: F.struct(k.alias("kind")))), "entities"))


def agg18(spark: S, sf: str) -> D:
    return evidence.forced_ends(table(spark, sf, "events").select(F.when(F.col("event_type") != "view", F.col("value") > 50).alias("forced")))


def agg19(spark: S, sf: str) -> D:
    return evidence.audit_counters(stand_ins.samples(spark, sf), validation.sample_rules(), "split")


def agg21(spark: S, sf: str) -> D:
    return reranking.suggested_names(table(spark, sf, "documents"), "doc_id", "text", ["the"])


def agg31(spark: S, sf: str) -> D:
    losses = table(spark, sf, "documents").select("lang", (F.length("text") / 1000.0).alias("nll"), F.size(F.split("text", " ")).alias("tokens"))
    return _rounded(reranking.perplexity(losses, "lang"))


def agg37(spark: S, sf: str) -> D:
    got = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 4).alias("cer"))
    return got.agg(F.min_by("l_suppkey", F.struct("cer", "l_suppkey")).alias("config"))


def agg39(spark: S, sf: str) -> D:
    t = stand_ins.samples(spark, sf).select("speaker", "session", F.substring("sha256", 1, 1).alias("date"))
    return t.groupBy("speaker", "session").agg(F.countDistinct("date").alias("dates")).where("dates > 1")


def agg40(spark: S, sf: str) -> D:
    t = table(spark, sf, "events").select("user_id", F.col("event_type").alias("gold"), F.when(F.col("value") > 40, F.col("event_type")).otherwise("x").alias("predicted"), (F.col("event_id") % 2).alias("mask"))
    return _rounded(evidence.token_accuracy(t, "user_id"))


def agg41(spark: S, sf: str) -> D:
    t = table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("source"), F.col("page_id").alias("ord"), F.length("html").cast("long").alias("bytes"))
    return evidence.budgeted(t, 60_000)


def flt10(spark: S, sf: str) -> D:
    t = turns(spark, sf)
    c = evidence.choices(F.col("text"), F.replace("text", F.lit(" "), F.lit("_")), F.array("text", F.concat("text", F.lit(".")), F.replace("text", F.lit("e"), F.lit("a"))))
    return t.select("i", F.array_join(c, "|").alias("choices"))


def _segments() -> F.Column:
    return F.array(F.struct((-F.col("value") / 100).alias("avg_logprob"), (F.col("value") / 200).alias("no_speech"), (F.col("value") / 30).alias("compression"), F.repeat("event_type", 5).alias("text"), F.lit(3).alias("tokens")))


def flt08(spark: S, sf: str) -> D:
    return table(spark, sf, "events").select("event_id", evidence.spoken_rejections(_segments()).alias("reason"))


def flt09(spark: S, sf: str) -> D:
    return _rounded(table(spark, sf, "events").select("event_id", evidence.heard_score(_segments()).alias("score")))


def flt13(spark: S, sf: str) -> D:
    t = stand_ins.samples(spark, sf).withColumn("units", F.filter(F.split(F.lower("reference"), ""), lambda c: c.rlike("[a-zéèê]")))
    return evidence.eligible(t, "units", list("abcdefghijklmnopqrstuvwxyz"))[1].select("sample_id", F.array_join(F.array_distinct("unsupported"), "").alias("unsupported"))


def flt17(spark: S, sf: str) -> D:
    t = table(spark, sf, "events")
    own = lambda k: F.when(F.col("event_id") % k == 0, F.lit("auto"))
    lang = F.when(F.col("user_id") % 2 == 0, "zh").otherwise("en")
    return t.select("event_id", evidence.policy(own(5), F.when(F.col("event_id") % 3 == 0, "review"), own(7), lang).alias("policy"))


def flt18(spark: S, sf: str) -> D:
    t = table(spark, sf, "events")
    return t.select("event_id", evidence.search_route(F.floor("value"), F.lit(100), F.when(F.col("event_type") != "view", F.col("value") < 20)).alias("route"))


def flt21(spark: S, sf: str) -> D:
    t = table(spark, sf, "documents").select("doc_id", "lang", "text")
    drawn = t.orderBy(F.sha2(F.concat(F.lit("9:"), F.col("doc_id").cast("string")), 256)).limit(80)
    saved = t.where("lang = 'fr'").select("text")
    return drawn.join(saved.distinct(), "text", "left_anti").orderBy(F.sha2(F.concat(F.lit("9:"), F.col("doc_id").cast("string")), 256)).limit(40).select("doc_id")


def set03(spark: S, sf: str) -> D:
    s = stand_ins.samples(spark, sf).select("sample_id")
    return s.withColumn("role", F.lit("sample")).unionByName(stand_ins.predictions(spark, sf).select("sample_id").withColumn("role", F.lit("prediction")))


def set08(spark: S, sf: str) -> D:
    return scoring.duplicated(table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_linenumber"), "l_partkey", "l_quantity", "l_linenumber")


def set09(spark: S, sf: str) -> D:
    from ..operators import auditing

    p = table(spark, sf, "pages").select("page_id", "url", F.md5("html").alias("sha256"))
    return auditing.blocked(p, p.where("page_id < 20"), "url", ["utm_source"]).select("page_id")


def set10(spark: S, sf: str) -> D:
    from ..functions import text

    return turns(spark, sf).select("i", F.array_join(F.array_distinct(text.words(F.col("text"))), " ").alias("words"))


def srt10(spark: S, sf: str) -> D:
    """The last three sessions' newest events of each user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").withColumn("place", F.row_number().over(w)).where("place <= 3").select("user_id", "event_id", F.col("place").cast("long").alias("place"))


def val21(spark: S, sf: str) -> D:
    p = table(spark, sf, "pages").select("page_id", F.length("html").alias("n"), F.md5("html").alias("h"))
    m = F.col("page_id") % 7
    return p.select("page_id", evidence.asset_state(F.when(m != 0, F.col("n")), F.when(m == 2, F.lit("x")).otherwise(F.col("h")), F.when(m == 1, F.col("n") + 1).otherwise(F.col("n")), F.col("h")).alias("state"))


def prj01(spark: S, sf: str) -> D:
    return evidence.label_digests(stand_ins.samples(spark, sf).select("sample_id", "reference"), "reference")


def flt20(spark: S, sf: str) -> D:
    one = reranking.unigrams(table(spark, sf, "conversations"), "conv_id", "text").select("token", "n")
    asked = reranking.tokens(table(spark, sf, "benchmark"), "item_id", "text").select("token").distinct()
    return asked.join(one, "token", "left").select("token", (F.coalesce("n", F.lit(0)) >= 2).alias("known"), (F.coalesce("n", F.lit(0)) >= 3).alias("common"))


def agg35(spark: S, sf: str) -> D:
    return _rounded(pairs(spark, sf).groupBy("split").agg(F.avg(F.abs(F.col("a_errors") - F.col("b_errors"))).alias("mean_gap"), scoring.ratio(F.sum(F.abs(F.col("a_errors") - F.col("b_errors"))), F.sum("characters")).alias("pooled_gap")))


def win02b(spark: S, sf: str) -> D:
    return sampling.first_by_hash(table(spark, sf, "customer"), "c_nationkey", "c_custkey", 3).select("c_custkey", F.col("place").cast("long").alias("place"))


_SEG = "(SELECT event_id, value, -value / 100 AS lp, value / 200 AS ns, value / 30 AS co, repeat(event_type, 5) AS t FROM events)"
QUERIES = {
    "jn05_report_covers_manifest": (jn05, WITH + "SELECT sample_id FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM predictions)"),
    "jn06_sidecar_with_defaults": (jn06, "SELECT d.doc_id AS sample_id, lang, coalesce(CASE WHEN toxic = 1 THEN 'bad' END, 'unknown') AS scene, coalesce(CAST(quality AS VARCHAR), 'unannotated') AS grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "jn11_shared_across_roles": (jn11, "WITH d AS (SELECT md5(text) AS text, lang || '-' || substr(source, 4, 1) AS g, CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'train' ELSE 'dev' END AS role FROM documents), l AS (SELECT 'text' AS key, text AS value, role FROM d UNION ALL SELECT 'group', g, role FROM d) SELECT key, value, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM l GROUP BY 1, 2 HAVING count(DISTINCT role) > 1"),
    "jn14_chunks_on_a_clock": (jn14, "WITH c AS (SELECT l_orderkey AS clip_id, l_linenumber AS chunk, CAST(l_quantity AS DOUBLE) AS t0, l_linenumber * 3.0 AS d FROM lineitem), g AS (SELECT o_orderkey AS clip_id, unnest(range(40)) AS k FROM orders), p AS (SELECT g.clip_id, k, max(chunk) AS value FROM g LEFT JOIN c ON c.clip_id = g.clip_id AND 5 + k >= t0 AND 5 + k < t0 + d GROUP BY 1, 2), s AS (SELECT *, count(value) OVER (PARTITION BY clip_id) / 40.0 AS share FROM p) SELECT clip_id, k, CAST(value AS DOUBLE) AS value FROM s WHERE value IS NOT NULL AND share > 0.5"),
    "jn21_vocabulary_coverage": (jn21, f"WITH a AS (SELECT DISTINCT unnest({_WORDS}) AS t FROM conversations WHERE role = 'assistant'), u AS (SELECT DISTINCT unnest({_WORDS}) AS t FROM conversations WHERE role = 'user') SELECT count(*) AS tokens, count(u.t) AS known, round(count(u.t) / count(*), 6) AS coverage FROM a LEFT JOIN u ON a.t = u.t"),
    "jn22_preparation_charge": (jn22, WITH + "SELECT domain, round(quantile_cont(CAST(processing_seconds + CASE WHEN domain = 'webcam' THEN duration_seconds / 10 ELSE 0 END AS DOUBLE), 0.95), 6) AS p95 FROM rated GROUP BY domain"),
    "agg03_percentiles": (agg03, "SELECT l_returnflag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95), 6) AS p95, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 6) AS p50 FROM lineitem GROUP BY 1"),
    "agg09_edit_metrics": (agg09, WITH + "SELECT domain, count(*) AS samples, CAST(sum(levenshtein(ref_key, hyp_key)) AS BIGINT) AS errors, round(sum(length(hyp_key)) / nullif(sum(length(ref_key)), 0), 6) AS length_ratio, round(sum(length(ref_key)) / count(*), 6) AS mean_reference FROM rated GROUP BY domain"),
    "agg15_entity_cohorts": (agg15, WITH + ", k AS (SELECT *, 'number' AS kind FROM rated WHERE contains(ref_key, 'the') UNION ALL SELECT *, 'person_name' FROM rated WHERE contains(ref_key, 'and') UNION ALL SELECT *, 'none' FROM rated WHERE NOT contains(ref_key, 'the') AND NOT contains(ref_key, 'and')) SELECT kind, count(*) AS samples, CAST(sum(errors) AS BIGINT) AS errors, round(sum(errors) / nullif(sum(characters), 0), 6) AS cer FROM k GROUP BY kind"),
    "agg18_forced_ends": (agg18, "WITH f AS (SELECT CASE WHEN event_type <> 'view' THEN value > 50 END AS f FROM events) SELECT count(*) FILTER (f) AS marked, count(f) AS reported, count(*) FILTER (f IS NULL) AS unreported FROM f"),
    "agg19_audit_counters": (agg19, WITH + "SELECT split, count(*) AS rows, count(*) FILTER (coalesce(trim(reference), '') = '') AS reference_is_blank, count(*) FILTER (speaker = '') AS speaker_is_blank, count(*) FILTER (domain NOT IN ('mouth_roi', 'full_face', 'webcam')) AS domain_is_unknown, count(*) FILTER (split NOT IN ('train', 'dev', 'test')) AS split_is_unknown, count(*) FILTER (NOT duration_seconds > 0) AS duration_is_not_positive, count(*) FILTER (domain = 'full_face' AND duration_seconds > 30) AS full_face_needs_short_clip, count(*) FILTER (NOT regexp_full_match(sha256, '[0-9a-f]{64}')) AS digest_is_not_sha256 FROM samples GROUP BY split"),
    "agg21_suggested_names": (agg21, r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\-]+'), 1) AS p FROM documents), f AS (SELECT *, w[1] <> lower(w[1]) AND p > 1 AND w <> upper(w) AND lower(w) NOT IN ('i', 'i''m', 'i''ll', 'i''ve', 'i''d') AS cap FROM w), c AS (SELECT w, count(*) FILTER (cap) AS caps, count(*) FILTER (w = lower(w)) AS plain, min((doc_id, p)) FILTER (cap) AS first FROM f GROUP BY w), t AS (SELECT * FROM c WHERE caps > 0 ORDER BY caps DESC, first LIMIT 200) SELECT t.w AS word, t.caps, coalesce(l.plain, 0) AS plain FROM t LEFT JOIN c l ON l.w = lower(t.w) WHERE t.caps >= 3 AND coalesce(l.plain, 0) < t.caps AND lower(t.w) <> 'the'"""),
    "agg31_perplexity": (agg31, "SELECT lang, round(exp(sum(length(text) / 1000.0) / greatest(sum(len(string_split(text, ' '))), 1)), 6) AS perplexity FROM documents GROUP BY lang"),
    "agg35_pooled_gaps": (agg35, WITH + _B + "SELECT split, round(avg(abs(a_errors - b_errors)), 6) AS mean_gap, round(sum(abs(a_errors - b_errors)) / nullif(sum(characters), 0), 6) AS pooled_gap FROM pairs GROUP BY split"),
    "agg37_argmin_configuration": (agg37, "WITH s AS (SELECT l_suppkey, round(avg(l_discount), 4) AS c FROM lineitem GROUP BY 1) SELECT l_suppkey AS config FROM s ORDER BY c, l_suppkey LIMIT 1"),
    "agg39_several_dates": (agg39, WITH + "SELECT speaker, session, count(DISTINCT substr(sha256, 1, 1)) AS dates FROM samples GROUP BY 1, 2 HAVING count(DISTINCT substr(sha256, 1, 1)) > 1"),
    "agg40_token_accuracy": (agg40, "SELECT user_id, count(*) FILTER (event_id % 2 = 1 AND value > 40) AS right, CAST(sum(event_id % 2) AS BIGINT) AS counted, round(count(*) FILTER (event_id % 2 = 1 AND value > 40) / nullif(sum(event_id % 2), 0), 6) AS accuracy FROM events GROUP BY 1"),
    "agg41_byte_budget": (agg41, "WITH p AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS source, page_id AS ord, length(html) AS bytes FROM pages), t AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY source ORDER BY ord) AS BIGINT) AS total FROM p) SELECT *, total <= 60000 AS within FROM t"),
    "flt08_spoken_rejections": (flt08, f"SELECT event_id, CASE WHEN lp < -0.85 THEN 'logprob' WHEN ns > 0.4 THEN 'no_speech' WHEN co > 2.4 THEN 'compression' ELSE 'repetition' END AS reason FROM {_SEG}"),
    "flt09_heard_scores": (flt09, f"SELECT event_id, round(CASE WHEN ns <= 0.6 THEN lp * 3 ELSE 0 END, 6) AS score FROM {_SEG}"),
    "flt10_delivery_choices": (flt10, _TURNS + ", c AS (SELECT i, [text, replace(text, ' ', '_'), text, text || '.', replace(text, 'e', 'a')] AS c FROM t), u AS (SELECT i, unnest(c) AS x, unnest(range(5)) AS p FROM c), d AS (SELECT i, x, min(p) AS p FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY p) AS r FROM d) SELECT i, string_agg(x, '|' ORDER BY p) AS choices FROM r WHERE r <= 3 GROUP BY i"),
    "flt13_ineligible_rows": (flt13, WITH + ", c AS (SELECT sample_id, unnest(regexp_extract_all(lower(reference), '[a-zéèê]')) AS c FROM samples) SELECT sample_id, string_agg(DISTINCT c, '' ORDER BY c) AS unsupported FROM c WHERE c IN ('é', 'è', 'ê') GROUP BY 1"),
    "flt17_policies": (flt17, "WITH p AS (SELECT event_id, user_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 'auto' END, CASE WHEN event_id % 3 = 0 THEN 'review' END, CASE WHEN event_id % 7 = 0 THEN 'auto' END, 'off') AS p FROM events) SELECT event_id, CASE WHEN user_id % 2 = 0 AND p = 'auto' THEN 'review' ELSE p END AS policy FROM p"),
    "flt18_search_routes": (flt18, "SELECT event_id, CASE WHEN floor(value) = 0 THEN 'skipped' WHEN floor(value) > 100 THEN 'sequential: workspace' WHEN coalesce(CASE WHEN event_type <> 'view' THEN value < 20 END, true) THEN 'sequential: near tie' ELSE 'batched' END AS route FROM events"),
    "flt20_known_words": (flt20, f"WITH o AS (SELECT unnest({_WORDS}) AS t FROM conversations), n AS (SELECT t, count(*) AS n FROM o GROUP BY 1), b AS (SELECT DISTINCT unnest({_WORDS}) AS token FROM benchmark) SELECT token, coalesce(n, 0) >= 2 AS known, coalesce(n, 0) >= 3 AS common FROM b LEFT JOIN n ON t = token"),
    "flt21_next_batch": (flt21, "WITH d AS (SELECT doc_id, lang, text, sha256('9:' || doc_id) AS o FROM documents), n AS (SELECT * FROM d ORDER BY o LIMIT 80) SELECT doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM d WHERE lang = 'fr' AND d.text = n.text) ORDER BY o LIMIT 40"),
    "prj01_label_digests": (prj01, WITH + "SELECT sample_id, sha256(reference) AS reference_sha256 FROM samples"),
    "set03_tagged_union": (set03, WITH + "SELECT sample_id, 'sample' AS role FROM samples UNION ALL SELECT sample_id, 'prediction' FROM predictions"),
    "set08_duplicate_clips": (set08, "SELECT l_partkey, l_quantity, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "set09_block_list": (set09, "SELECT page_id FROM pages WHERE md5(html) IN (SELECT md5(html) FROM pages WHERE page_id < 20) OR contains(url, 'utm_source')"),
    "set10_ordered_distinct": (set10, _TURNS + f", w AS (SELECT i, unnest({_WORDS}) AS w, unnest(range(len({_WORDS}))) AS p FROM t), d AS (SELECT i, w, min(p) AS p FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY p) AS r FROM d) SELECT t.i, coalesce(string_agg(w, ' ' ORDER BY p), '') AS words FROM t LEFT JOIN r ON t.i = r.i GROUP BY 1"),
    "srt10_newest_of_each": (srt10, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 3"),
    "val21_asset_states": (val21, "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid_size' WHEN 2 THEN 'invalid_hash' ELSE 'ready' END AS state FROM pages"),
    "win02_first_by_hash": (win02b, "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(CAST(c_custkey AS VARCHAR)), c_custkey) AS place FROM customer QUALIFY place <= 3"),
}
