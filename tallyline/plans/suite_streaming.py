"""Streaming queries: the supplied events as a stream of files, read once to their end.

Their output goes to a folder of its own beside the checkpoints (spark.checkpoint.dir), which executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from ..streaming import live, stateful

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = F.col("ts").cast("timestamp")
    return raw.select("event_id", "user_id", at.alias("at"), (F.unix_micros(at) / 1e6).alias("ts"), F.col("event_type").alias("kind"), "value", F.col("event_id").alias("ord"))


def in_order(rows: DataFrame, at: str = "at", key: str = "user_id") -> DataFrame:
    """``rows`` as a stream of a few micro-batches, earlier ones first; of each key they have a bounded number of rows."""
    spark = rows.sparkSession
    path = stateful.time_split(rows, at, _folder(spark))
    files = stateful.files_a_trigger(spark.read.schema(rows.schema).parquet(path), key)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    at = F.col("ts").cast("timestamp")
    return e.select("event_id", "user_id", at.alias("at"), (F.unix_micros(at) / 1e6).alias("ts"), F.col("event_type").alias("kind"), "value", F.col("event_id").alias("ord"))


def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as keys, an hour as 1/100 of a second, so that holds, taps and double taps all occur."""
    kind = F.element_at(F.array(*map(F.lit, ("down", "up", "other", "esc"))), (F.pmod(F.length("kind"), F.lit(3)) + F.when(F.col("value") > 150, 2).otherwise(1)).cast("int"))
    keys = table(spark, sf_dir).select("user_id", (F.col("ts") / 360_000).alias("ts"), kind.alias("kind"), "ord")
    return live.drained(live.dictation_actions(in_order(keys, "ts")), spark, _folder(spark))


def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = live.drained(live.tumbling_counts(events(spark, sf_dir), "1 day", "1 hour"), spark, _folder(spark), "complete")
    return got.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "n", F.round("total", 2).alias("total"))


def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = live.drained(live.sessions(events(spark, sf_dir), "86399.999999 seconds", "1 hour"), spark, _folder(spark), "complete")
    return got.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n")


def str08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(live.rate_limited(in_order(table(spark, sf_dir).select("user_id", "ts", "ord"), "ts"), 3 * 86_400.0), spark, _folder(spark)).select("user_id", "ord")


def str09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return live.bounded(e.select("user_id", F.col("event_id").alias("ord"), F.round("value", 0).alias("seconds")), 500.0)


def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's newest token (its last event type by name) the last text; drafts lose against finals."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    results = e.select("user_id", F.col("event_type").alias("token"), (F.col("event_id") % 3 == 0).alias("final"), F.col("event_id").alias("version"), F.concat(F.lit("t"), "event_id").alias("text"))
    return live.current(results)


def str12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dictations before each, as its context."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, -1)
    return e.select("event_id", F.array_join(F.collect_list(F.col("event_id").cast("string")).over(w), " ").alias("context"))


def str10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 15th result is the user's own text, every 5th final, others are drafts; 25 ids make a dictation."""
    kind = F.when(F.col("event_id") % 15 == 1, "edit").when(F.col("event_id") % 5 == 0, "final").otherwise("draft")
    rows = table(spark, sf_dir).select("at", F.floor(F.col("event_id") / 25).alias("token"), kind.alias("kind"), F.col("event_id").alias("version"), F.concat(F.lit("t"), "event_id").alias("text"))
    return stateful.upserted(in_order(rows, key="token"), _folder(spark))


def str11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases open watches, other events say what a user's field holds; an hour stands for a second."""
    rows = table(spark, sf_dir).select("user_id", "at", "ord", (F.col("kind") == "purchase").alias("opens"), F.concat(F.lit("e"), "event_id").alias("text"))
    return live.drained(stateful.delayed_checks(in_order(rows), "user_id", (4 * 3600.0, 12 * 3600.0, 30 * 3600.0), "1 hour"), spark, _folder(spark))


def str13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events as frames, odd ones as blocks of audio of the same user, on one clock: two hours of latency, six hours of reach."""
    rows = table(spark, sf_dir).select("user_id", "at", "ord")
    frames, audio = (in_order(rows.where(F.col("ord") % 2 == side)) for side in (0, 1))
    return live.drained(stateful.nearest_match(frames, audio, "user_id", 7200.0, 21600.0, "1 hour"), spark, _folder(spark))


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as presses, releases and what spoils them, an hour as 1/100 of a second."""
    e = table(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("press", "release", "press", "release", "press", "release", "key_down", "key_up", "button_down", "button_up", "scroll", "modifier")))
    i = F.col("event_id")
    return e.select(
        "user_id", F.timestamp_micros(F.floor(F.unix_micros("at") / 360_000)).alias("at"), "ord", (F.floor(F.unix_micros("at") / (8 * 86_400_000_000)) - (i % 29 == 0).cast("long")).alias("generation"),
        F.element_at(kinds, (F.pmod(i * 37 + F.col("user_id"), F.lit(12)) + 1).cast("int")).alias("kind"), (F.lit(52) + i % 3).cast("int").alias("code"), (i % 17 == 0).alias("modified"), (i % 5 == 0).alias("again"))


def str15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.drained(stateful.clean_taps(in_order(taps(spark, sf_dir)), "user_id", "1 millisecond"), spark, _folder(spark))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reads of a user's camera: one in three gives no frame, purchases are recorded; a day stands for a second."""
    i = F.col("event_id")
    return table(spark, sf_dir).select("user_id", "at", "ord", (i % 3 != 0).alias("valid"), (F.col("kind") == "purchase").alias("recording"))


def str07(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = live.drained(stateful.camera_reads(in_order(reads(spark, sf_dir)), "user_id", 86_400.0, 86_400.0, "1 hour"), spark, _folder(spark))
    return got.where("what = 'failed'").drop("what")


def str14(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = live.drained(stateful.camera_reads(in_order(reads(spark, sf_dir)), "user_id", 1e6 * 86_400.0, 86_400.0, "1 hour"), spark, _folder(spark))
    return got.where("what = 'tracked'").drop("what")


_PASSED = "us <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)"
_READS = "SELECT user_id, event_id AS ord, epoch_us(ts) AS us, event_id % 3 <> 0 AS valid, event_type = 'purchase' AS recording FROM events"

QUERIES = {
    "str01_push_to_talk": (str01, None),
    "str02_tumbling_windows": (str02, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "str03_session_windows": (str03, "WITH e AS (SELECT user_id, ts, event_id, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 86400, true) AS fresh FROM events), s AS (SELECT user_id, ts, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) AS n FROM s GROUP BY user_id, s"),
    "str04_current_results": (str04, "WITH r AS (SELECT user_id, event_type AS token, event_id % 3 = 0 AS final, event_id, 't' || event_id AS text, max(event_type) OVER (PARTITION BY user_id) AS newest FROM events) SELECT user_id, token, arg_max(text, (final, event_id)) AS text FROM r WHERE token = newest GROUP BY 1, 2"),
    "str08_rate_limit": (str08, None),
    "str09_bounded_buffer": (str09, "WITH e AS (SELECT user_id, event_id AS ord, round(value, 0) AS s, sum(round(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM events) SELECT user_id, ord, CAST(greatest(0, least(s, 500 - (t - s))) AS DOUBLE) AS kept FROM e"),
    "str12_context": (str12, "SELECT event_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ' ') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM events"),
    "str10_draft_then_final": (str10, "WITH r AS (SELECT event_id // 25 AS token, CAST(CASE WHEN event_id % 15 = 1 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS rank, event_id AS version, 't' || event_id AS text FROM events) SELECT token, max(rank) AS rank, arg_max(version, (rank, version)) AS version, arg_max(text, (rank, version)) AS text FROM r GROUP BY token"),
    "str11_delayed_checks": (str11, "WITH c AS (SELECT user_id, ts, event_id, v.n AS number, epoch_us(ts) + v.h * 3600000000 AS due_us FROM events, (VALUES (1, 4), (2, 12), (3, 30)) v(n, h) WHERE event_type = 'purchase') SELECT user_id, event_id AS ord, number, due_us, (SELECT arg_max('e' || f.event_id, (f.ts, f.event_id)) FROM events f WHERE f.user_id = c.user_id AND f.event_type <> 'purchase' AND epoch_us(f.ts) <= due_us AND (f.ts, f.event_id) > (c.ts, c.event_id)) AS seen FROM c WHERE due_us <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)"),
    "str13_nearest_audio": (str13, "WITH l AS (SELECT user_id, event_id AS ord, epoch_us(ts) - 7200000000 AS t FROM events WHERE event_id % 2 = 0), p AS (SELECT l.user_id, l.ord, r.event_id, epoch_us(r.ts) - t AS apart, r.ts FROM l JOIN events r ON r.user_id = l.user_id AND r.event_id % 2 = 1 AND abs(epoch_us(r.ts) - t) <= 21600000000), b AS (SELECT user_id, ord, arg_min(event_id, (abs(apart), ts, event_id)) AS match, arg_min(apart, (abs(apart), ts, event_id)) AS apart_us FROM p GROUP BY 1, 2) SELECT l.user_id, l.ord, b.match, b.apart_us FROM l LEFT JOIN b USING (user_id, ord) WHERE t + 21600000000 <= (SELECT least(epoch_us(max(ts) FILTER (event_id % 2 = 0)), epoch_us(max(ts) FILTER (event_id % 2 = 1))) // 1000 * 1000 - 3600000000 FROM events)"),
    "str15_clean_taps": (str15, None),
    "str07_read_failures": (str07, "WITH e AS (" + _READS + "), p AS (SELECT *, coalesce(max(CASE WHEN valid THEN us END) OVER w, first_value(us) OVER w) AS good FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, ord ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, ord) AS n FROM p WHERE NOT valid AND us - good >= 86400000000) SELECT user_id, us, ord FROM f WHERE n = 1 AND " + _PASSED),
    "str14_preview_tracking": (str14, "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, ord) AS n FROM (" + _READS + ") WHERE valid), r AS (SELECT *, us AS last_one, true AS tracked FROM e WHERE n = 1 UNION ALL SELECT e.*, CASE WHEN e.recording OR e.us - r.last_one >= 86400000000 THEN e.us ELSE r.last_one END, e.recording OR e.us - r.last_one >= 86400000000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT user_id, us, ord FROM r WHERE tracked AND " + _PASSED),
}
