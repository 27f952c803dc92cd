"""Queries of frames, decoder scores, checkpoints and archives. Embeddings stand in for frames and log-probabilities, events for checkpoints, documents for archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decoding, warps
from . import stand_ins
from .suite_text import frames

S, D = SparkSession, DataFrame


def _sums(df: D, *keys: str) -> D:
    weighted = F.aggregate(F.zip_with("pixels", F.sequence(F.lit(1), F.size("pixels")), lambda p, i: p * i), F.lit(0.0), lambda s, x: s + x)
    return df.select(*keys, F.size("pixels").alias("n"), F.round(weighted, 4).alias("weighted"))


def arr02(spark: S, sf: str) -> D:
    return _sums(warps.stressed(frames(spark, sf), warps.STRESS["synthetic_moderate"], 8, 8), "clip_id", "frame_no")


def arr03(spark: S, sf: str) -> D:
    return _sums(warps.stressed_then_stabilised(frames(spark, sf), "synthetic_mild", "stabilize_moderate", 8, 8), "clip_id", "frame_no")


def arr05(spark: S, sf: str) -> D:
    """Mean change of each frame under every pair of presets."""
    f, out = frames(spark, sf), None
    for stress in warps.STRESS:
        for preset in warps.STABILISATION:
            one = warps.stressed_then_stabilised(f, stress, preset, 8, 8).select("clip_id", "frame_no", F.col("pixels").alias("new"))
            moved = F.aggregate(F.zip_with("pixels", "new", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
            row = f.join(one, ["clip_id", "frame_no"]).groupBy().agg(F.sum(moved).alias("moved"), F.count("*").alias("frames")).select(F.lit(stress).alias("stress"), F.lit(preset).alias("preset"), "moved", "frames")
            out = row if out is None else out.unionByName(row)
    return out


def arr06(spark: S, sf: str) -> D:
    colours = F.flatten(F.transform("pixels", lambda p: F.array(p, 255 - p, (p * 7) % 256)))
    return _sums(warps.crop_grid(frames(spark, sf).withColumn("pixels", colours), 8, 8), "clip_id", "frame_no", "crop")


EDGE = 63


def arr11(spark: S, sf: str) -> D:
    """Candidates of 0 to 6 tokens, five to an utterance; row t of the log-probabilities is the embedding turned by 13 t."""
    e = stand_ins.table(spark, sf, "embeddings").select("vec_id", (F.floor(F.col("vec_id") / 5)).alias("utterance"), F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("p"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.pmod(F.col("vec_id") * (i + 3), F.lit(62)) + 1).cast("int"))
    c = decoding.reversed_inputs(e.withColumn("tokens", F.slice(tokens, 1, (F.col("vec_id") % 7).cast("int"))), "utterance", "tokens", EDGE)
    rows = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda t: F.concat(F.slice("p", t * 9 + 1, F.lit(64)), F.slice(F.col("p"), F.lit(1), t * 9)))
    score = decoding.gathered_score(rows, F.col("targets"), F.col("valid"))
    return c.select("vec_id", F.size("targets").alias("width"), F.array_join("inputs", ",").alias("inputs"), F.round(score, 6).alias("score"))


def srt07(spark: S, sf: str) -> D:
    e = stand_ins.table(spark, sf, "embeddings")
    key = [F.floor(F.col("vec_id") / 5).alias("utterance"), (F.col("vec_id") % 5).alias("hypothesis")]
    hyps = e.select(*key, F.element_at("embedding", 1).cast("double").alias("score"))
    steps = e.select(*key, F.posexplode("embedding").alias("token", "x")).select("utterance", "hypothesis", "token", F.round("x", 2).cast("double").alias("first"), F.col("x").cast("double").alias("full"))
    return decoding.beam_step(hyps, steps, 8, 1.5).withColumn("score", F.round("score", 9))


def val23(spark: S, sf: str) -> D:
    """A user's events as checkpoints: every 17th repeats its epoch, every 23rd skips one; the clock counts events, some are set back."""
    e = stand_ins.table(spark, sf, "events").withColumn("run", F.col("user_id") * 1000 + F.floor(F.col("event_id") / 500))
    i = F.col("event_id")
    rows = e.select("run", i.alias("step"), (F.floor(i % 500 / 50) + 1 - (i % 17 == 0).cast("int") + (i % 23 == 0).cast("int")).alias("epoch"), F.when(i % 41 == 0, "other").otherwise("same").alias("identity"), F.when(i % 61 != 0, (i % 500 - F.when(i % 29 == 0, 200).otherwise(0)).cast("double")).alias("elapsed"), F.lit(450.0).alias("budget"))
    return decoding.resume_issues(rows)


def jn17(spark: S, sf: str) -> D:
    d = stand_ins.table(spark, sf, "documents")
    i = F.col("doc_id")
    members = d.select(F.concat(F.lit("set"), i % 3, F.lit("/"), "source", F.lit("/"), "lang", F.lit("/FACE/"), (i % 97).cast("string"), F.lit(".mp4")).alias("name"))
    paths = F.array(F.concat("source", F.lit("/"), "lang", F.lit("/FACE/"), ((i * 3) % 97).cast("string"), F.lit(".mp4")), F.when(i % 4 == 0, F.concat(F.lit("FACE/"), (i % 97).cast("string"), F.lit(".mp4"))))
    return decoding.archive_members(members, d.select(i.alias("id"), paths.alias("paths")))


_E = "WITH e AS (SELECT vec_id, vec_id // 5 AS utterance, vec_id % 5 AS hypothesis, embedding FROM embeddings)"
QUERIES = {
    "arr02_camera_stress": (arr02, None),
    "arr03_stress_then_stabilise": (arr03, None),
    "arr05_presets": (arr05, None),
    "arr06_crop_grid": (arr06, None),
    "arr11_reverse_scores": (arr11, _E + ", t AS (SELECT *, list_transform(range(CAST(vec_id % 7 AS BIGINT)), lambda i: (vec_id * (i + 3)) % 62 + 1) AS tokens, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) AS p FROM e), r AS (SELECT *, list_concat(list_reverse(tokens), [63]) AS targets, max(len(tokens) + 1) OVER (PARTITION BY utterance) AS width FROM t) SELECT vec_id, CAST(width AS INTEGER) AS width, array_to_string(list_concat([63], list_reverse(tokens), list_transform(range(width - len(tokens) - 1), lambda i: 0)), ',') AS inputs, round(list_sum(list_transform(targets, lambda t, i: p[(t + (i - 1) * 9) % 64 + 1])), 6) AS score FROM r"),
    "srt07_beam_step": (srt07, _E + ", s AS (SELECT utterance, hypothesis, generate_subscripts(embedding, 1) - 1 AS token, unnest(embedding) AS x, CAST(embedding[1] AS DOUBLE) AS so_far FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY utterance, hypothesis ORDER BY round(x, 2) DESC, token) AS n FROM s), b AS (SELECT utterance, hypothesis, token, so_far + CAST(x AS DOUBLE) AS score FROM f WHERE n <= 12), r AS (SELECT *, row_number() OVER (PARTITION BY utterance ORDER BY score DESC, hypothesis, token) AS place FROM b) SELECT utterance, CAST(place AS INTEGER) AS place, hypothesis, CAST(token AS INTEGER) AS token, round(score, 9) AS score FROM r WHERE place <= 8"),
    "val23_resume_checks": (val23, "WITH c AS (SELECT user_id * 1000 + event_id // 500 AS run, event_id AS step, event_id % 500 // 50 + 1 - CAST(event_id % 17 = 0 AS INT) + CAST(event_id % 23 = 0 AS INT) AS epoch, CASE WHEN event_id % 41 = 0 THEN 'other' ELSE 'same' END AS identity, CASE WHEN event_id % 61 <> 0 THEN event_id % 500 - CASE WHEN event_id % 29 = 0 THEN 200 ELSE 0 END END AS elapsed FROM events), m AS (SELECT *, (SELECT max(b.epoch) FROM c b WHERE b.run = c.run AND b.step < c.step) AS greatest_, (SELECT count(*) FROM c b WHERE b.run = c.run AND b.step < c.step) AS earlier, (SELECT count(*) FROM c b WHERE b.run = c.run AND b.step < c.step AND b.epoch = c.epoch) AS there, (SELECT arg_min(b.identity, b.step) FROM c b WHERE b.run = c.run) AS first_, (SELECT max(b.elapsed) FROM c b WHERE b.run = c.run AND b.step < c.step AND b.elapsed >= 0) AS used FROM c) SELECT run, step, 'identity' AS issue FROM m WHERE identity <> first_ UNION ALL SELECT run, step, 'start' FROM m WHERE earlier = 0 AND epoch <> 1 UNION ALL SELECT run, step, 'repeat' FROM m WHERE there > 0 UNION ALL SELECT run, step, 'gap' FROM m WHERE earlier > 0 AND there = 0 AND epoch <> greatest_ + 1 UNION ALL SELECT run, step, 'clock' FROM m WHERE elapsed IS NULL OR elapsed < 0 UNION ALL SELECT run, step, 'back' FROM m WHERE elapsed >= 0 AND elapsed < used UNION ALL SELECT run, step, 'overdrawn' FROM m WHERE elapsed >= 0 AND greatest(elapsed, coalesce(used, 0)) > 450"),
    "jn17_archive_members": (jn17, "WITH n AS (SELECT DISTINCT 'set' || doc_id % 3 || '/' || source || '/' || lang || '/FACE/' || doc_id % 97 || '.mp4' AS name FROM documents), p AS (SELECT doc_id AS id, source || '/' || lang || '/FACE/' || doc_id * 3 % 97 || '.mp4' AS a, CASE WHEN doc_id % 4 = 0 THEN 'FACE/' || doc_id % 97 || '.mp4' END AS b FROM documents), h AS (SELECT p.id, count(name) AS n, min(name) AS member FROM p LEFT JOIN n ON ends_with('/' || name, '/' || a) OR ends_with('/' || name, '/' || b) GROUP BY p.id) SELECT id, CASE n WHEN 0 THEN 'missing' WHEN 1 THEN 'one' ELSE 'several' END AS status, CASE WHEN n = 1 THEN member END AS member, n FROM h"),
}
