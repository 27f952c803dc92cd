"""Queries over candidate lists, personal corpora and ordered frames.

Candidate lists: the turns of a conversation as hypotheses for its first user turn. Frames: a user's events in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edit, text
from ..operators import candidates, reranking, timeseries
from . import stand_ins
from .suite_scoring import _rounded, rated

_KEY = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_RANKED = "WITH c AS (SELECT conv_id AS sample_id, turn, text, " + _KEY.format("text") + " AS key, first_value(" + _KEY.format("text") + ") OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations), ranked AS (SELECT sample_id, turn AS rank, text, key, ref, levenshtein(key, ref) AS errors, length(ref) AS characters, length(text) / -10.0 AS score, length(key) / 5 + 1 AS tokens FROM c WHERE turn > 0) "
_W = "regexp_extract_all(replace(replace(lower({0}), 'ß', 'ss'), '’', ''''), '[\\x{{4e00}}-\\x{{9fff}}]|[a-z0-9]+(?:''[a-z0-9]+)*')"
_FRAMES = "WITH f AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, epoch(ts) AS ts, value, event_type FROM events) "


def _key(c) -> F.Column:  # noqa: ANN001
    return text.ascii_key(c)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per candidate; each meets its conversation's first turn, so no list is ever one row."""
    t = stand_ins.table(spark, sf_dir, "conversations")
    first = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"))
    flat = t.where("turn > 0").select("conv_id", F.col("turn").alias("rank"), "text", (F.length("text") / -10.0).alias("score")).join(first, "conv_id").withColumnRenamed("conv_id", "sample_id")
    k, r = _key(F.col("text")), _key(F.col("reference"))
    return flat.withColumns({"key": k, "ref": r}).withColumns({"errors": edit.distance(F.col("key"), F.col("ref")), "characters": F.length("ref").cast("long"), "tokens": F.length("key") / 5 + 1})


def jn15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("sample_id", F.col("rank").cast("long").alias("rank"), "errors", "characters")


def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(candidates.oracle_at(ranked(spark, sf_dir), [1, 3, 5, 10]))


def win03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.best_rank(ranked(spark, sf_dir)).select("sample_id", F.col("rank").cast("long").alias("rank"), "errors")


def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.distinct_texts(ranked(spark, sf_dir), F.col("key"), 3).select("sample_id", "key", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


def flt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(candidates.margins(ranked(spark, sf_dir)))


def jn16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(candidates.diversity(ranked(spark, sf_dir), F.col("key")))


def agg36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.medoids(ranked(spark, sf_dir), F.col("key")).select("sample_id", F.col("rank").cast("long").alias("rank"))


def srt04(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = candidates.rescored(ranked(spark, sf_dir), F.col("score") + 0.5 * F.col("tokens") + F.length("key") / 10.0)  # a tenth as decimals have it: ties count
    return got.where("new_rank = 1").select("sample_id", F.col("rank").cast("long").alias("rank"))


def srt05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir).withColumns({"forward": F.col("tokens"), "reverse": F.length("text") / 7.0, "any_forced": F.col("sample_id") % 5 == 0})
    return _rounded(candidates.rescored(rows, candidates.reverse_score(0.1, 0.3)).select("sample_id", F.col("rank").cast("long").alias("rank"), "new_score", F.col("new_rank").cast("long").alias("new_rank")))


def srt06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.near_ties(ranked(spark, sf_dir), 1.5)


def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return t.select("doc_id", candidates.repetitive(F.col("w")).alias("repetitive"))


def sc03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of all samples; their edits must sum to the distance."""
    rows = rated(spark, sf_dir).withColumn("alignment", edit.alignment("ref_key", "hyp_key"))
    return rows.select("sample_id", (F.col("alignment.substitutions") + F.col("alignment.deletions") + F.col("alignment.insertions")).alias("errors"), (F.col("alignment.matches") + F.col("alignment.substitutions") + F.col("alignment.deletions")).alias("characters"))


def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rated(spark, sf_dir).withColumn("alignment", edit.alignment("ref_key", "hyp_key"))
    return candidates.error_operations(rows, "sample_id")


def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(c,) for c in "abcdefghijklmnopqrstuvwxyz "], "character string")
    rows = stand_ins.samples(spark, sf_dir).withColumn("low", F.lower("reference"))
    return candidates.unknown_characters(rows, "low", known)


def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranking.unigrams(stand_ins.table(spark, sf_dir, "documents"), "doc_id", "text")


def agg22b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranking.bigrams(stand_ins.table(spark, sf_dir, "conversations"), "text")


def sc40(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return _rounded(reranking.bigram_scores(t.where("role = 'assistant'"), "k", "text", t.where("role = 'user'"), "text"))


def jn18(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "conversations")
    q = t.where("turn = 0").select(F.col("conv_id").alias("q"), "text")
    p = stand_ins.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), "text")
    return _rounded(reranking.similar(q, p).select("q", "i", "score"))


def srt01(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reranking.by_own_words(ranked(spark, sf_dir), ["the", "and", "with"])
    return got.select("sample_id", F.col("rank").cast("long").alias("rank"), F.col("hits").cast("long").alias("hits"), F.col("new_rank").cast("long").alias("new_rank"))


def srt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reranking.reranked(ranked(spark, sf_dir), F.col("score") / F.col("tokens"))
    return got.select("sample_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranking.distinctive(stand_ins.table(spark, sf_dir, "documents"), "doc_id", "text", 50, ["the", "and", "der", "die", "que", "les"])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = stand_ins.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("clip_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame_no"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "value", "event_type")


def ts01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip's events on a grid of one instant in two days."""
    return timeseries.resampled(frames(spark, sf_dir), 1 / 172_800).select("clip_id", F.col("k").cast("long").alias("k"), F.col("frame_no").cast("long").alias("frame_no"))


def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("v", F.when(F.col("event_type") != "view", F.col("value")))
    return _rounded(timeseries.filled(f, "v").select("clip_id", F.col("frame_no").cast("long").alias("frame_no"), "filled"))


def win06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(timeseries.smoothed(frames(spark, sf_dir), "value").select("clip_id", F.col("frame_no").cast("long").alias("frame_no"), "smooth"))


def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "click", F.col("value")))
    return _rounded(f.select("clip_id", F.col("frame_no").cast("long").alias("frame_no"), timeseries.carried(f, "v").alias("carried")))


def win13(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("token", F.ascii("event_type") % 4)
    return timeseries.collapsed(f, "token").select("clip_id", F.col("frame_no").cast("long").alias("frame_no"), F.col("token").cast("long").alias("token"))


def ts06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.rates(frames(spark, sf_dir)).select("clip_id", "frames", F.round(F.col("fps") * 1e6, 3).alias("fps_e6"))


def flt07(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumns({"face": F.col("event_type") != "error", "mouth_open": F.col("value")})
    return timeseries.clip_problems(f)


def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stand_ins.table(spark, sf_dir, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return timeseries.joined_sessions(e, 86_400).select("event_id", F.col("session").cast("long").alias("session"))


def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of turns cut into cues at commas and full stops."""
    t = stand_ins.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), F.posexplode(F.split(F.regexp_replace("text", "\n", " "), "(?<=[,.]) ")).alias("cue", "text"))
    cues = t.withColumns({"start": F.col("cue").cast("double"), "end": F.col("cue") + 0.9})
    return timeseries.sentences(cues).select("file", F.col("sentence").cast("long").alias("sentence"), "text", F.col("words").cast("long").alias("words"))


QUERIES = {
    "jn15_candidates_by_reference": (jn15, _RANKED + "SELECT sample_id, rank, errors, characters FROM ranked"),
    "agg16_oracle_at_k": (agg16, _RANKED + ", b AS (SELECT *, min(errors) OVER (PARTITION BY sample_id ORDER BY rank) AS best, max(rank) OVER (PARTITION BY sample_id) AS top FROM ranked) SELECT k, count(*) AS samples, CAST(sum(best) AS BIGINT) AS errors, CAST(sum(characters) AS BIGINT) AS characters, round(sum(best) / nullif(sum(characters), 0), 6) AS cer FROM b, (VALUES (1), (3), (5), (10)) v(k) WHERE rank = least(k, top) GROUP BY k"),
    "win03_earliest_best_rank": (win03, _RANKED + "SELECT sample_id, rank, errors FROM ranked QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY errors, rank) = 1"),
    "win04_distinct_choices": (win04, _RANKED + ", d AS (SELECT sample_id, key AS key, min(rank) AS rank FROM ranked WHERE key <> '' GROUP BY 1, 2) SELECT sample_id, key, rank, row_number() OVER (PARTITION BY sample_id ORDER BY rank) AS place FROM d QUALIFY place <= 3"),
    "flt06_margins": (flt06, _RANKED + "SELECT sample_id, round(max(score / greatest(tokens, 1)) FILTER (rank = 1) - max(score / greatest(tokens, 1)) FILTER (rank = 2), 6) AS margin FROM ranked GROUP BY sample_id"),
    "jn16_candidate_diversity": (jn16, _RANKED + ", d AS (SELECT sample_id, key AS key, min(rank) AS rank FROM ranked WHERE key <> '' GROUP BY 1, 2) SELECT a.sample_id, count(*) AS pairs, round(avg(levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key), 1)), 6) AS mean_distance FROM d a JOIN d b ON a.sample_id = b.sample_id AND a.rank < b.rank GROUP BY 1"),
    "agg36_medoids": (agg36, _RANKED + ", d AS (SELECT sample_id, key AS key, min(rank) AS rank FROM ranked WHERE key <> '' GROUP BY 1, 2), m AS (SELECT a.sample_id, a.rank, avg(levenshtein(a.key, b.key)) AS mean FROM d a JOIN d b ON a.sample_id = b.sample_id AND a.rank <> b.rank GROUP BY 1, 2) SELECT sample_id, rank FROM m QUALIFY mean <= min(mean) OVER (PARTITION BY sample_id) + 1e-12"),
    "srt04_rescored_first": (srt04, _RANKED + "SELECT sample_id, rank FROM ranked QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score + 0.5 * tokens + 0.1 * length(key) DESC, rank) = 1"),
    "srt05_reverse_rescoring": (srt05, _RANKED + ", r AS (SELECT *, CASE WHEN sample_id % 5 = 0 THEN score ELSE score + 0.9 * 0.3 * (length(text) / 7.0 - tokens) END AS s FROM ranked) SELECT sample_id, rank, round(s, 6) AS new_score, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, rank) AS new_rank FROM r"),
    "srt06_near_ties": (srt06, _RANKED + ", g AS (SELECT sample_id, score - lead(score) OVER (PARTITION BY sample_id ORDER BY score DESC, rank) AS gap FROM ranked) SELECT sample_id, coalesce(min(gap) < 1.5, false) AS fallback FROM g GROUP BY sample_id"),
    "win14_repetition": (win14, None),
    "sc03_alignments": (sc03, "WITH" + stand_ins.SAMPLES_SQL + "SELECT sample_id, levenshtein(ref_key, hyp_key) AS errors, length(ref_key) AS characters FROM rated"),
    "agg11_commonest_edits": (agg11, None),
    "agg12_unknown_characters": (agg12, "WITH" + stand_ins.SAMPLES_SQL + ", c AS (SELECT sample_id, unnest(string_split(lower(reference), '')) AS character FROM samples) SELECT character, count(*) AS occurrences, count(DISTINCT sample_id) AS rows FROM c WHERE character <> '' AND NOT regexp_matches(character, '^[a-z ]$') GROUP BY character"),
    "agg22_unigrams": (agg22, "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '[\\x{4e00}-\\x{9fff}]|[a-z0-9]+(?:''[a-z0-9]+)*')) AS token FROM documents) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t GROUP BY token"),
    "agg22_bigrams": (agg22b, "WITH w AS (SELECT list_concat(['<s>'], regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '[\\x{4e00}-\\x{9fff}]|[a-z0-9]+(?:''[a-z0-9]+)*')) AS w FROM conversations), p AS (SELECT unnest(list_zip(w[1:-2], w[2:])) AS p FROM w) SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM p GROUP BY 1, 2"),
    "sc40_bigram_scores": (sc40, "WITH w AS (SELECT conv_id * 1000 + turn AS k, role, list_concat(['<s>'], " + _W.format("text") + ") AS w FROM conversations), z AS (SELECT k, role, unnest(list_zip(w[1:-2], w[2:])) AS p FROM w), p AS (SELECT k, role, p[1] AS a, p[2] AS b FROM z), two AS (SELECT a, b, count(*) AS n FROM p WHERE role = 'user' GROUP BY 1, 2), one AS (SELECT b, sum(n) AS nb FROM two GROUP BY 1), bef AS (SELECT a, sum(n) AS na FROM two GROUP BY 1), tot AS (SELECT sum(nb) AS everything, count(*) AS kinds FROM one) SELECT k, round(avg(ln(0.6 * coalesce(n / na, 0) + 0.4 * (coalesce(nb, 0) + 0.1) / (everything + 0.1 * kinds))), 6) AS score FROM p LEFT JOIN two USING (a, b) LEFT JOIN bef USING (a) LEFT JOIN one USING (b), tot WHERE role = 'assistant' GROUP BY k"),
    "jn18_similar_phrases": (jn18, "WITH o AS (SELECT DISTINCT item_id AS i, unnest(" + _W.format("text") + ") AS t FROM benchmark), d AS (SELECT t, ln((SELECT count(*) FROM benchmark) / count(*)) AS idf FROM o GROUP BY 1), q AS (SELECT DISTINCT conv_id AS q, unnest(" + _W.format("text") + ") AS t FROM conversations WHERE turn = 0), s AS (SELECT q, i, round(sum(idf), 9) AS score FROM q JOIN o USING (t) JOIN d USING (t) GROUP BY 1, 2) SELECT q, i, round(score, 6) AS score FROM s WHERE score > 2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, i DESC) <= 3"),
    "srt01_own_words_first": (srt01, _RANKED + ", h AS (SELECT *, CAST(contains(' ' || lower(text) || ' ', ' the ') AS INT) + CAST(contains(' ' || lower(text) || ' ', ' and ') AS INT) + CAST(contains(' ' || lower(text) || ' ', ' with ') AS INT) AS hits FROM ranked) SELECT sample_id, rank, CAST(hits AS BIGINT) AS hits, row_number() OVER (PARTITION BY sample_id ORDER BY hits DESC, rank) AS new_rank FROM h"),
    "srt02_reranked": (srt02, _RANKED + "SELECT sample_id, rank, row_number() OVER (PARTITION BY sample_id ORDER BY score / tokens - 0.35 * rank DESC, rank) AS new_rank FROM ranked"),
    "agg23_distinctive_words": (agg23, "WITH t AS (SELECT unnest(regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '[\\x{4e00}-\\x{9fff}]|[a-z0-9]+(?:''[a-z0-9]+)*')) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 250) SELECT token, n FROM c WHERE length(token) > 2 AND token NOT IN ('the', 'and', 'der', 'die', 'que', 'les') ORDER BY n DESC, token LIMIT 50"),
    "ts01_nearest_resample": (ts01, _FRAMES + ", g AS (SELECT clip_id, min(ts) AS t0, max(ts) AS t1, bool_and(ok) AS valid FROM (SELECT *, coalesce(lag(ts) OVER (PARTITION BY clip_id ORDER BY frame_no) < ts, true) AS ok FROM f) GROUP BY 1), i AS (SELECT clip_id, unnest(generate_series(0, CAST(floor((t1 - t0) / 172800 + 1e-6) AS BIGINT))) AS k, t0 FROM g WHERE valid) SELECT i.clip_id, i.k, arg_min(frame_no, (abs(ts - (t0 + k * 172800)), ts)) AS frame_no FROM i JOIN f USING (clip_id) GROUP BY 1, 2 UNION ALL SELECT clip_id, frame_no, frame_no FROM f JOIN g USING (clip_id) WHERE NOT valid"),
    "win07_gap_filling": (win07, _FRAMES + ", v AS (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v FROM f), n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN frame_no END IGNORE NULLS) OVER w AS ln, last_value(v IGNORE NULLS) OVER w AS lv, first_value(CASE WHEN v IS NOT NULL THEN frame_no END IGNORE NULLS) OVER x AS rn, first_value(v IGNORE NULLS) OVER x AS rv FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT clip_id, frame_no, round(coalesce(v, CASE WHEN ln IS NOT NULL AND rn IS NOT NULL THEN lv + (rv - lv) * (frame_no - ln) / (rn - ln) END, lv, rv), 6) AS filled FROM n"),
    "win06_shrinking_average": (win06, _FRAMES + ", n AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM f), m AS (SELECT *, least(6, frame_no, n - 1 - frame_no) AS m FROM n) SELECT a.clip_id, a.frame_no, round(avg(b.value), 6) AS smooth FROM m a JOIN f b ON a.clip_id = b.clip_id AND b.frame_no BETWEEN a.frame_no - a.m AND a.frame_no + a.m GROUP BY 1, 2"),
    "win08_carry_forward": (win08, _FRAMES + "SELECT clip_id, frame_no, round(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING), 6) AS carried FROM f"),
    "win13_collapse": (win13, _FRAMES + ", t AS (SELECT clip_id, frame_no, ascii(event_type) % 4 AS token, lag(ascii(event_type) % 4) OVER (PARTITION BY clip_id ORDER BY frame_no) AS b FROM f) SELECT clip_id, frame_no, CAST(token AS BIGINT) AS token FROM t WHERE (b IS NULL OR b <> token) AND token <> 0"),
    "ts06_frame_rates": (ts06, _FRAMES + "SELECT clip_id, count(*) AS frames, round(CASE WHEN max(ts) > min(ts) THEN (count(*) - 1) / (max(ts) - min(ts)) ELSE 0 END * 1e6, 3) AS fps_e6 FROM f GROUP BY 1"),
    "flt07_clip_problems": (flt07, _FRAMES + "SELECT clip_id, CASE WHEN max(ts) - min(ts) < 0.6 OR count(*) < 12 THEN 'short' WHEN avg(CAST(event_type <> 'error' AS DOUBLE)) < 0.4 THEN 'face' WHEN coalesce(stddev_pop(value) FILTER (value > 0), 0) < 0.012 THEN 'still' ELSE 'ok' END AS problem FROM f GROUP BY 1"),
    "str03_session_gaps": (str03, "WITH e AS (SELECT event_id, user_id, ts, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 86400, true) AS fresh FROM events) SELECT event_id, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM e"),
    "win09_sentences": (win09, "WITH l AS (SELECT conv_id * 1000 + turn AS file, regexp_split_to_array(regexp_replace(replace(text, chr(10), ' '), '([,.]) ', '\\1' || chr(1), 'g'), chr(1)) AS c FROM conversations), u AS (SELECT file, unnest(c) AS t, unnest(range(len(c))) AS cue FROM l), e AS (SELECT *, CAST(regexp_matches(t, '[.!?][\"'')]*\\s*$') AS INT) AS e FROM u), n AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY file ORDER BY cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e), j AS (SELECT file, CAST(s AS BIGINT) AS sentence, string_agg(t, ' ' ORDER BY cue) AS text, max(cue) - min(cue) + 0.9 AS d FROM n GROUP BY 1, 2) SELECT file, sentence, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM j WHERE d < 12 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) BETWEEN 4 AND 30"),
}
