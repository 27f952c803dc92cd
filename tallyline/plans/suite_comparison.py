"""Queries that compare two results, audit splits, sample and select."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import auditing, comparison, sampling, scoring, selection
from . import stand_ins
from .suite_scoring import WITH, _rounded, rated

#: The second result: what the first recognised, cut to its first 200 characters, and nothing rejected.
_B = ", b_rows AS (SELECT sample_id, speaker, split, domain, ref_key, characters, hyp_key AS hyp_key FROM rated), b AS (SELECT *, CASE WHEN hyp_key <> '' THEN levenshtein(hyp_key, ref_key) ELSE characters END AS errors, hyp_key <> '' AND hyp_key = ref_key AS exact FROM b_rows), pairs AS (SELECT a.sample_id, a.characters, a.speaker, a.session, a.domain, a.split, a.errors AS a_errors, a.exact AS a_exact, b.errors AS b_errors, b.exact AS b_exact FROM rated a JOIN b USING (sample_id)) "
_DELTA = "count(*) AS samples, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(a_errors) AS BIGINT) AS a_errors, CAST(sum(b_errors) AS BIGINT) AS b_errors, count(*) FILTER (a_exact) AS a_exact, count(*) FILTER (b_exact) AS b_exact, round(sum(a_errors) / nullif(sum(characters), 0), 6) AS a_cer, round(sum(b_errors) / nullif(sum(characters), 0), 6) AS b_cer, round(100 * (sum(b_errors) - sum(a_errors)) / nullif(sum(characters), 0), 6) AS delta_pp"


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir).withColumns({"raw": F.col("hyp_key"), "action": F.lit("review"), "error": F.lit(None).cast("string")})
    return scoring.scored(rows, text.ascii_key)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.paired(rated(spark, sf_dir), second(spark, sf_dir), ["speaker", "session", "domain", "split"])


def jn03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.unpaired(stand_ins.samples(spark, sf_dir), stand_ins.predictions(spark, sf_dir))


def jn04(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stand_ins.samples(spark, sf_dir)
    b = stand_ins.predictions(spark, sf_dir).select("sample_id", F.col("raw").alias("reference"), F.lit("s1").alias("speaker"), F.col("error").alias("domain"))
    return comparison.mismatches(a, b, ["reference", "speaker"], ["domain"])


def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(comparison.deltas(pairs(spark, sf_dir)))


def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(comparison.deltas(pairs(spark, sf_dir), "speaker"))


def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(comparison.cluster_bootstrap(pairs(spark, sf_dir), draws=2000))


def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(comparison.cohorts(pairs(spark, sf_dir), {"domain": ["webcam", "full_face", "mouth_roi", "phone"], "split": None, "session": None}))


def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _rounded(comparison.named_cohorts(pairs(spark, sf_dir), {"webcam_test": (c("domain") == "webcam") & (c("split") == "test"), "long": c("characters") > 150, "not_train": c("split") != "train"}))


def set01(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"speaker": F.col("speaker"), "hash": F.col("sha256"), "reference": text.ascii_key(F.col("reference"))}
    return auditing.split_overlaps(stand_ins.samples(spark, sf_dir), keys, [("train", "dev"), ("train", "test"), ("dev", "test")])


def jn07(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_ins.samples(spark, sf_dir).withColumn("start", text.ascii_key(F.col("reference")))
    return auditing.exposed(s.where("split = 'test'"), s.where("split <> 'test'"), ["session", "sha256", "start"])


def jn08(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_ins.samples(spark, sf_dir)
    return s.where("split = 'test'").join(s.where("split = 'train'").select("speaker", "session").distinct(), ["speaker", "session"], "left_semi").select("sample_id")


def jn09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of one order as intervals [ship, receipt) in days."""
    days = lambda c: F.datediff(F.col(c), F.lit("1992-01-01"))
    lines = stand_ins.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), days("l_shipdate").alias("s"), (days("l_shipdate") + F.col("l_linenumber") * 9).alias("e"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"))
    return auditing.overlapping(lines, "k", "s", "e", "i")


def jn10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditing.contradictions(stand_ins.samples(spark, sf_dir), "speaker", "session")


def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auditing.differences(stand_ins.samples(spark, sf_dir), stand_ins.predictions(spark, sf_dir), "sample_id")


def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_ins.samples(spark, sf_dir)
    return auditing.excluding(s, s.where("domain = 'webcam' and session = 'r0'"), "speaker").select("sample_id")


def set13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_ins.samples(spark, sf_dir)
    return auditing.exposure(s.where("split = 'test'"), s.where("split = 'train'"), s.where("split = 'dev'"), "session").groupBy("exposure").count()


def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stand_ins.table(spark, sf_dir, "documents")
    return sampling.round_robin(docs, "source", "doc_id", groups=7, n=40, seed=13).select("doc_id", "source", F.col("round").cast("long").alias("round"), F.col("place").cast("long").alias("place"))


def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_by_hash(stand_ins.table(spark, sf_dir, "documents"), "source", "doc_id", 2).select("doc_id", "source", F.col("place").cast("long").alias("place"))


def ml07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.held_out(stand_ins.table(spark, sf_dir, "documents"), "doc_id", 60).select("doc_id", "part")


def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("i"), F.regexp_extract("text", "^([A-Za-z]+ [A-Za-z]+)", 1).alias("p"))
    return sampling.first_wins(t, "p", "i").select("i", "p")


def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.latest(stand_ins.table(spark, sf_dir, "pages").select("url", "page_id").withColumn("name", F.lpad(F.col("page_id").cast("string"), 8, "0")), "name", 100).select("name")


def flt11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stand_ins.samples(spark, sf_dir)
    return sampling.pending(s, s.where("split = 'train'"), lambda c: text.ascii_key(c)).select("sample_id")


def srt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations are suppliers' nations, conditions the return flags; errors, exact and coverage are counts over order lines."""
    lines = stand_ins.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), F.col("l_suppkey") % 8).alias("config"), (F.col("l_suppkey") % 8).alias("ord"), F.col("l_linestatus").alias("condition"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    got = lines.groupBy("config", "ord", "condition").agg(F.count_if(F.col("d") > 0.05).alias("errors"), F.count_if(F.col("t") == 0).alias("exact"), F.lit(1.0).alias("coverage"), F.lit(0).alias("failures"))
    got = got.withColumns({"errors": F.when(F.col("ord") == 0, F.col("errors") + 1000).otherwise(F.col("errors")), "exact": F.when(F.col("ord") == 0, 0).otherwise(F.col("exact"))})
    return selection.gated_choice(got, "c0")


def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = stand_ins.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.round("value", 4).alias("cer"))
    return selection.improvements(epochs)


def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = stand_ins.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.round("value", 2).cast("decimal(18,2)").alias("seconds"))
    return selection.ledger(steps, 500).select("run", "step", F.col("elapsed").cast("double").alias("elapsed"), "within")


_SEED = "sha256('13:' || {0})"
QUERIES = {
    "jn03_pairing_completeness": (jn03, WITH + "SELECT coalesce(s.sample_id, p.sample_id) AS sample_id, CASE WHEN s.sample_id IS NULL THEN 'unexpected' ELSE 'missing' END AS side FROM samples s FULL JOIN predictions p ON s.sample_id = p.sample_id WHERE s.sample_id IS NULL OR p.sample_id IS NULL"),
    "jn04_identity_mismatches": (jn04, WITH + "SELECT s.sample_id, 'reference' AS field FROM samples s JOIN predictions p USING (sample_id) WHERE NOT coalesce(s.reference = p.raw, false) UNION ALL SELECT s.sample_id, 'speaker' FROM samples s JOIN predictions p USING (sample_id) WHERE s.speaker <> 's1' UNION ALL SELECT s.sample_id, 'domain' FROM samples s JOIN predictions p USING (sample_id) WHERE s.domain IS DISTINCT FROM p.error"),
    "agg06_deltas": (agg06, WITH + _B + f"SELECT {_DELTA} FROM pairs"),
    "agg07_deltas_by_speaker": (agg07, WITH + _B + f"SELECT speaker, {_DELTA} FROM pairs GROUP BY speaker"),
    "agg08_cluster_bootstrap": (agg08, None),
    "agg13_cohorts": (agg13, WITH + _B + f", long AS (SELECT *, unnest([{{'dimension': 'domain', 'value': domain}}, {{'dimension': 'split', 'value': split}}, {{'dimension': 'session', 'value': session}}]) AS v FROM pairs) SELECT v.dimension AS dimension, v.value AS value, {_DELTA} FROM long GROUP BY 1, 2 UNION ALL SELECT 'domain', 'phone', 0, 0, 0, 0, 0, 0, NULL, NULL, NULL"),
    "agg14_named_cohorts": (agg14, WITH + _B + f", long AS (SELECT *, 'webcam_test' AS cohort FROM pairs WHERE domain = 'webcam' AND split = 'test' UNION ALL SELECT *, 'long' FROM pairs WHERE characters > 150 UNION ALL SELECT *, 'not_train' FROM pairs WHERE split <> 'train') SELECT cohort, {_DELTA} FROM long GROUP BY cohort"),
    "set01_split_overlaps": (set01, WITH + ", long AS (SELECT split, 'speaker' AS key, speaker AS value FROM samples UNION SELECT split, 'hash', sha256 FROM samples UNION SELECT split, 'reference', regexp_replace(lower(reference), '[^a-z0-9]', '', 'g') FROM samples) SELECT a.key, a.split AS first, b.split AS second, a.value FROM long a JOIN long b ON a.key = b.key AND a.value = b.value WHERE a.value <> '' AND (a.split, b.split) IN (('train', 'dev'), ('train', 'test'), ('dev', 'test'))"),
    "jn07_development_exposure": (jn07, WITH + ", k AS (SELECT *, regexp_replace(lower(reference), '[^a-z0-9]', '', 'g') AS start FROM samples), d AS (SELECT * FROM k WHERE split <> 'test') SELECT sample_id FROM k WHERE split = 'test' AND (session IN (SELECT session FROM d) OR sha256 IN (SELECT sha256 FROM d) OR start IN (SELECT start FROM d))"),
    "jn08_composite_semi_join": (jn08, WITH + "SELECT sample_id FROM samples WHERE split = 'test' AND (speaker, session) IN (SELECT (speaker, session) FROM samples WHERE split = 'train')"),
    "jn09_interval_overlap": (jn09, "WITH i AS (SELECT l_orderkey AS k, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_linenumber * 9 AS e, l_orderkey * 10 + l_linenumber AS i FROM lineitem) SELECT a.i AS first, b.i AS second FROM i a JOIN i b ON a.k = b.k AND a.i < b.i AND greatest(a.s, b.s) < least(a.e, b.e)"),
    "jn10_contradictions": (jn10, WITH + "SELECT speaker, count(DISTINCT session) AS values FROM samples GROUP BY speaker HAVING count(DISTINCT session) > 1"),
    "set04_set_difference": (set04, WITH + "SELECT sample_id, 'missing' AS side FROM (SELECT sample_id FROM samples EXCEPT SELECT sample_id FROM predictions) UNION ALL SELECT sample_id, 'unexpected' FROM (SELECT sample_id FROM predictions EXCEPT SELECT sample_id FROM samples)"),
    "set06_exclude_prior_speakers": (set06, WITH + "SELECT sample_id FROM samples WHERE speaker NOT IN (SELECT speaker FROM samples WHERE domain = 'webcam' AND session = 'r0')"),
    "set13_exposure_labels": (set13, WITH + "SELECT CASE WHEN session IN (SELECT session FROM samples WHERE split IN ('train', 'dev')) THEN 'seen' ELSE 'unseen' END AS exposure, count(*) AS count FROM samples WHERE split = 'test' GROUP BY 1"),
    "win01_round_robin_sample": (win01, f"WITH g AS (SELECT source, row_number() OVER (ORDER BY {_SEED.format('source')}) AS gr FROM (SELECT DISTINCT source FROM documents) QUALIFY gr <= 7), r AS (SELECT doc_id, source, gr, row_number() OVER (PARTITION BY source ORDER BY {_SEED.format('doc_id')}, doc_id) AS round FROM documents JOIN g USING (source)), p AS (SELECT *, row_number() OVER (ORDER BY round, gr) AS place FROM r) SELECT doc_id, source, round, place FROM p WHERE place <= 40"),
    "win02_first_two_by_hash": (win02, "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents QUALIFY place <= 2"),
    "ml07_held_out_split": (ml07, "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('1:' || doc_id), doc_id) <= 60 THEN 'test' ELSE 'train' END AS part FROM documents"),
    "agg20_first_wins_distinct": (agg20, "WITH t AS (SELECT conv_id * 1000 + turn AS i, regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1) AS p FROM conversations) SELECT i, p FROM t WHERE p <> '' QUALIFY row_number() OVER (PARTITION BY lower(p) ORDER BY i) = 1"),
    "snk06_keep_latest": (snk06, "SELECT lpad(CAST(page_id AS VARCHAR), 8, '0') AS name FROM pages ORDER BY name DESC LIMIT 100"),
    "flt11_pending_prompts": (flt11, WITH + ", k AS (SELECT *, regexp_replace(lower(reference), '[^a-z0-9]', '', 'g') AS s5 FROM samples) SELECT sample_id FROM k WHERE s5 NOT IN (SELECT s5 FROM k WHERE split = 'train')"),
    "srt12_gated_selection": (srt12, "WITH l AS (SELECT 'c' || (l_suppkey % 8) AS config, l_suppkey % 8 AS ord, l_linestatus AS condition, count(*) FILTER (l_discount > 0.05) AS errors, count(*) FILTER (l_tax = 0) AS exact FROM lineitem GROUP BY ALL), r AS (SELECT config, ord, condition, CASE WHEN ord = 0 THEN errors + 1000 ELSE errors END AS errors, CASE WHEN ord = 0 THEN 0 ELSE exact END AS exact FROM l), b AS (SELECT condition, errors AS be, exact AS bx FROM r WHERE config = 'c0'), s AS (SELECT config, ord, sum(errors) AS errors, bool_and(errors <= be AND exact >= bx) AND sum(errors) < sum(be) AND config <> 'c0' AS ok FROM r JOIN b USING (condition) GROUP BY config, ord) SELECT coalesce((SELECT config FROM s WHERE ok ORDER BY errors, ord LIMIT 1), 'c0') AS config, (SELECT count(*) FROM s WHERE ok) AS eligible"),
    "win11_strictly_best_so_far": (win11, "WITH e AS (SELECT user_id AS run, event_id AS epoch, round(value, 4) AS cer, min(round(value, 4)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT run, epoch, cer FROM e WHERE b IS NULL OR cer < b"),
    "win12_budget_ledger": (win12, "WITH e AS (SELECT user_id AS run, event_id AS step, CAST(round(value, 2) AS DECIMAL(18,2)) AS seconds FROM events), s AS (SELECT run, step, sum(seconds) OVER (PARTITION BY run ORDER BY step) AS elapsed FROM e) SELECT run, step, CAST(elapsed AS DOUBLE) AS elapsed, elapsed <= 500 AS within FROM s"),
}
