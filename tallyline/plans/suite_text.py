"""Queries over text transforms, guards, pixels, validation and table discovery.

Pixels: an embedding's values as grey levels, a label as a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewrite, text
from ..operators import pixels, validation
from ..sources import readers
from . import stand_ins
from .suite_scoring import _rounded


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_ins.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("i"), "text", "role")


def sc01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_ins.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.characters("text")).alias("key_md5"))


def sc04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", F.array_join(text.words(F.col("text")), " ").alias("words"))


def sc08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", text.contains_term(F.col("text"), "The").alias("the"), text.contains_term(F.col("text"), "ing").alias("ing"), text.has_han(F.col("text")).alias("han"))


def sc11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy(text.length_bucket(F.length("text")).alias("bucket")).count()


def sc14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stand_ins.table(spark, sf_dir, "documents").select("doc_id", F.length(text.compact(F.col("text"))).cast("long").alias("n"))


def sc17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", text.decoded(F.regexp_replace(F.concat("text", F.lit("<eos>")), " t", "▁t")).alias("decoded"))


def sc18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", F.regexp_count("text", F.lit("the")).cast("long").alias("n"))


def sc20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", rewrite.numbers_to_digits(F.regexp_replace("text", r"\b(the|of)\b", "twenty six")).alias("text"))


def sc21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", rewrite.basic_cleanup(F.col("text")).alias("text"))


def sc23(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.regexp_replace(F.regexp_replace("text", r"\bis\b", "is not"), r"\bthat\b", "12")
    return turns(spark, sf_dir).select("i", F.array_join(rewrite.guard_warnings(F.col("text"), new, F.array(F.lit("the and")), ["And"]), ",").alias("warnings"))


def set11(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("b", F.reverse("text"))
    return t.select("i", rewrite.same_bag(F.col("text"), F.col("b"), "ere|[.]").alias("same"))


def sc28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", rewrite.apply_case(F.col("text"), ["The", "AND"]).alias("text"))


def sc29(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return t.select("w", rewrite.visemes("w").alias("shapes"))


def sc31(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = rewrite.name_snapper(["Therona", "Andelia"], frozenset(["the", "and", "of"]), frozenset(["to", "in"]))
    return stand_ins.table(spark, sf_dir, "benchmark").select("item_id", snap(F.col("text")).alias("text"))


def sc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", F.array_join(rewrite.extracted_names(F.col("text"), ["the", "and"]), " ").alias("names"))


def sc33(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.concat(F.substring("text", 1, 10), F.lit("XYZ"), F.substr("text", F.lit(11)))
    return turns(spark, sf_dir).select("i", rewrite.inserted_span(F.col("text"), after).alias("span"))


def sc35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("i", F.posexplode(rewrite.training_lines(F.col("text"))).alias("pos", "line")).select("i", F.col("pos").cast("long").alias("pos"), "line")


def sc38(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = rewrite.strict_reply(F.col("props"), ["k"])
    return stand_ins.table(spark, sf_dir, "events").select("event_id", reply.isNotNull().alias("fine"), F.get_json_object("props", "$.k").alias("k"))


def sc44(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "documents")
    return t.select("doc_id", text.seed_of(F.col("doc_id").cast("string"), 77).alias("seed"), text.is_sha256(F.sha2(F.col("doc_id").cast("string"), 256)).alias("fine"))


def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Practice sentences: 5 to 12 words, no digits or addresses, each once, in seeded hash order."""
    s = turns(spark, sf_dir).select(F.explode(F.split("text", r"[.!?\n]+")).alias("s")).select(F.trim("s").alias("s")).where(~F.col("s").rlike("[0-9@/]"))
    s = s.where(F.size(F.split("s", r"\s+")).between(5, 12)).distinct()
    return s.orderBy(F.sha2(F.concat(F.lit("5:"), "s"), 256)).limit(100)


def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.text_columns(stand_ins.table(spark, sf_dir, "conversations").withColumns({"rare": F.when(F.col("turn") >= 4, F.col("text")), "path": F.concat(F.lit("/data/"), "text")})).select("column", "values", "filled", F.round("share", 6).alias("share"))


def val_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"))
    return validation.date_violations(t, "d", "o_orderkey")


def val05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded sums of orders against those of their lines."""
    orders = stand_ins.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 7 + 1).alias("lines"))
    lines = stand_ins.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("lines"))
    return validation.changed(orders, lines, "k", ["lines"])


def val04(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stand_ins.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), (F.col("l_quantity") - 3).alias("s"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber") * 8.0).alias("e"))
    return validation.violations(t, validation.interval_rules("s", "e"), "i")


def val14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stand_ins.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("frame_no"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return validation.not_increasing(e, "user_id", "t")


def val16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stand_ins.table(spark, sf_dir, "pages")
    plan = p.select(F.col("page_id").cast("string").alias("path"), F.md5("html").alias("sha256"))
    seen = p.where("page_id % 10 <> 0").select(F.col("page_id").cast("string").alias("path"), F.when(F.col("page_id") % 10 == 1, F.md5("url")).otherwise(F.md5("html")).alias("sha256"))
    return validation.changed_files(plan, seen)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey levels of an embedding: 128 + 400 * value, within 0 and 255."""
    e = stand_ins.table(spark, sf_dir, "embeddings")
    grey = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 400 + 128).cast("int"))))
    return e.select(F.col("label").alias("clip_id"), F.col("vec_id").alias("frame_no"), grey.alias("pixels"))


def arr01(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pixels.stabilised(frames(spark, sf_dir), pixels.Stabilisation(strength=0.37))
    total = F.aggregate("pixels", F.lit(0), lambda a, p: a + p)
    return got.select("clip_id", "frame_no", total.cast("long").alias("total"), "usable", _cut("gain"), _cut("offset"))


def arr04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pixels.quality(frames(spark, sf_dir)))


def arr07(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = pixels.normalised(F.col("pixels"), 8, 6)
    return _rounded(frames(spark, sf_dir).select("frame_no", F.size(n).cast("long").alias("n"), F.aggregate(n, F.lit(0.0), lambda a, x: a + x).alias("total")))


def _cut(c: str) -> F.Column:
    """Six places, alike in any engine for values that lie half-way."""
    return (F.floor(F.col(c) * 1e6 + 0.25) / 1e6).alias(c)


def agg28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.brightness_trend(frames(spark, sf_dir)).select("clip_id", "frame_no", _cut("mean"), _cut("so_far"))


_WORDS = "regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), '’', ''''), '[\\x{4e00}-\\x{9fff}]|[a-z0-9]+(?:''[a-z]+)?')"
_TURNS = "WITH t AS (SELECT conv_id * 1000 + turn AS i, text, role FROM conversations) "
_GREY = "WITH f AS (SELECT label AS clip_id, vec_id AS frame_no, list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor(CAST(v AS DOUBLE) * 400 + 128) AS INT)))) AS pixels FROM embeddings) "
QUERIES = {
    "sc01_unicode_characters": (sc01, None),
    "sc04_words": (sc04, _TURNS + f"SELECT i, array_to_string({_WORDS}, ' ') AS words FROM t"),
    "sc08_contains_terms": (sc08, _TURNS + "SELECT i, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') AS the, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])ing($|[^A-Za-z0-9_])') AS ing, false AS han FROM t"),
    "sc11_length_buckets": (sc11, _TURNS + "SELECT CASE WHEN length(text) <= 20 THEN '1-20' WHEN length(text) <= 40 THEN '21-40' WHEN length(text) <= 60 THEN '41-60' ELSE '61+' END AS bucket, count(*) AS count FROM t GROUP BY 1"),
    "sc14_compact_length": (sc14, "SELECT doc_id, length(regexp_replace(text, '[\\s\\p{P}]', '', 'g')) AS n FROM documents"),
    "sc17_decoded_text": (sc17, _TURNS + "SELECT i, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS decoded FROM t"),
    "sc18_marker_counts": (sc18, _TURNS + "SELECT i, len(regexp_extract_all(text, 'the')) AS n FROM t"),
    "sc20_numbers_to_digits": (sc20, None),
    "sc21_basic_cleanup": (sc21, None),
    "sc23_rewrite_guard": (sc23, None),
    "set11_same_bags": (set11, _TURNS + "SELECT i, list_sort(regexp_extract_all(text, 'ere|[.]')) = list_sort(regexp_extract_all(reverse(text), 'ere|[.]')) AS same FROM t"),
    "sc28_own_spelling": (sc28, _TURNS + ", a AS (SELECT i, regexp_replace(regexp_replace(text, '(?i)(^|[^A-Za-z0-9_])the\\b', '\\1The', 'g'), '(?i)(^|[^A-Za-z0-9_])the\\b', '\\1The', 'g') AS x FROM t) SELECT i, regexp_replace(regexp_replace(x, '(?i)(^|[^A-Za-z0-9_])and\\b', '\\1AND', 'g'), '(?i)(^|[^A-Za-z0-9_])and\\b', '\\1AND', 'g') AS text FROM a"),
    "sc29_visemes": (sc29, None),
    "sc31_snapped_names": (sc31, None),
    "sc32_extracted_names": (sc32, None),
    "sc33_inserted_span": (sc33, _TURNS + "SELECT i, 'XYZ' AS span FROM t"),
    "sc35_training_lines": (sc35, None),
    "sc38_strict_replies": (sc38, "SELECT event_id, list_sort(json_keys(props)) = ['k'] AND json_type(props, '$.k') IS NOT NULL AS fine, props ->> '$.k' AS k FROM events"),
    "sc44_sample_seeds": (sc44, "SELECT doc_id, CAST((CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 9, 8) AS BIGINT) + 77) % 4294967296 AS BIGINT) AS seed, true AS fine FROM documents"),
    "flt12_practice_sentences": (flt12, "WITH s AS (SELECT DISTINCT trim(unnest(regexp_split_to_array(text, '[.!?\\n]+'))) AS s FROM conversations) SELECT s FROM s WHERE NOT regexp_matches(s, '[0-9@/]') AND len(regexp_split_to_array(s, '\\s+')) BETWEEN 5 AND 12 ORDER BY sha256('5:' || s) LIMIT 100"),
    "src05_text_columns": (src05, r"""WITH l AS (SELECT unnest([{'c': 'text', 'v': text}, {'c': 'role', 'v': role}, {'c': 'rare', 'v': CASE WHEN turn >= 4 THEN text END}, {'c': 'path', 'v': '/data/' || text}]) AS x FROM conversations), f AS (SELECT x.c AS "column", x.v AS v FROM l WHERE x.v IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY md5(v), v) AS place, count(*) OVER (PARTITION BY "column") AS filled FROM f), j AS (SELECT "column", filled, len(list_filter(regexp_split_to_array(v, '\s+'), lambda w: w <> '')) BETWEEN 2 AND 400 AND length(regexp_replace(v, '[^\p{L}\s]', '', 'g')) / greatest(length(v), 1) > 0.85 AND NOT regexp_matches(v, '^\s*([{\[/]|http)') AS good FROM r WHERE place <= 300) SELECT "column", count(*) AS "values", any_value(filled) AS filled, round(avg(CAST(good AS INT)), 6) AS share FROM j GROUP BY 1 HAVING count(*) >= 5 AND avg(CAST(good AS INT)) > 0.6"""),
    "val20_iso_dates": (val_days, "SELECT o_orderkey, 'date_is_not_iso' AS rule FROM orders WHERE o_orderkey % 3 = 0 AND (month(CAST(o_orderdate AS DATE)) < 10 OR day(CAST(o_orderdate AS DATE)) < 10)"),
    "val05_recorded_counts": (val05, "SELECT k, 'lines' AS \"column\" FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 + 1 END AS r FROM orders) JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) USING (k) WHERE r IS NOT NULL AND r <> n"),
    "val04_interval_rules": (val04, "WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS i, l_quantity - 3 AS s, CASE WHEN l_linenumber <> 2 THEN l_linenumber * 8.0 END AS e FROM lineitem) SELECT i, 'start_is_negative' AS rule FROM t WHERE NOT s >= 0 UNION ALL SELECT i, 'end_is_not_behind_start' FROM t WHERE e IS NOT NULL AND NOT e > s"),
    "val14_monotonic_times": (val14, "WITH t AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT DISTINCT user_id FROM t WHERE b >= ts"),
    "val16_changed_files": (val16, "SELECT CAST(page_id AS VARCHAR) AS path, CASE WHEN page_id % 10 = 0 THEN 'missing' ELSE md5(url) END AS now FROM pages WHERE page_id % 10 IN (0, 1)"),
    "arr04_pixel_quality": (arr04, _GREY + ", p AS (SELECT clip_id, frame_no, unnest(pixels) AS p FROM f), m AS (SELECT clip_id, frame_no, avg(p) AS m FROM p GROUP BY 1, 2), a AS (SELECT clip_id, round(avg(m), 6) AS mean_brightness, round(stddev_pop(m), 6) AS frame_brightness_std FROM m GROUP BY 1), b AS (SELECT clip_id, round(stddev_pop(p), 6) AS pixel_contrast_std, round(avg(CAST(p IN (0, 255) AS INT)), 6) AS saturated_fraction FROM p GROUP BY 1) SELECT * FROM a JOIN b USING (clip_id)"),
    "arr07_normalised_crops": (arr07, _GREY + ", p AS (SELECT frame_no, unnest(pixels) AS p, unnest(range(64)) AS i FROM f) SELECT frame_no, count(*) AS n, round(sum((p / 255.0 - 0.421) / 0.165), 6) AS total FROM p WHERE i // 8 BETWEEN 1 AND 6 AND i % 8 BETWEEN 1 AND 6 GROUP BY 1"),
    "agg28_brightness_trend": (agg28, _GREY + ", m AS (SELECT clip_id, frame_no, avg(p) AS mean FROM (SELECT clip_id, frame_no, unnest(pixels) AS p FROM f) GROUP BY 1, 2) SELECT clip_id, frame_no, floor(mean * 1e6 + 0.25) / 1e6 AS mean, floor(avg(mean) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING) * 1e6 + 0.25) / 1e6 AS so_far FROM m"),
}
QUERIES["arr01_stabilised_frames"] = (arr01, _GREY + """, p AS (SELECT clip_id, frame_no, unnest(pixels) AS p FROM f),
q AS (SELECT clip_id, frame_no, quantile_cont(CAST(p AS DOUBLE), 0.5) AS b, quantile_cont(CAST(p AS DOUBLE), 0.9) - quantile_cont(CAST(p AS DOUBLE), 0.1) AS c, avg(CAST(p IN (0, 255) AS INT)) AS x FROM p GROUP BY 1, 2),
u AS (SELECT *, b BETWEEN 20 AND 235 AND c >= 8 AND x <= 0.2 AS usable FROM q),
t AS (SELECT clip_id, quantile_cont(b, 0.5) AS tb, quantile_cont(c, 0.5) AS tc FROM u WHERE usable GROUP BY 1),
g AS (SELECT u.*, tb, CASE WHEN usable THEN 1 + 0.37 * (greatest(1 / 1.5, least(1.5, tc / c)) - 1) ELSE 1.0 END AS gain FROM u LEFT JOIN t USING (clip_id)),
o AS (SELECT *, CASE WHEN usable THEN 0.37 * greatest(-24.0, least(24.0, tb - gain * b)) ELSE 0.0 END AS "offset" FROM g)
SELECT o.clip_id, o.frame_no, CAST(sum(CASE WHEN usable THEN greatest(0, least(255, CAST(CASE WHEN p * gain + "offset" - floor(p * gain + "offset") = 0.5 THEN 2 * round((p * gain + "offset") / 2) ELSE round(p * gain + "offset") END AS INT))) ELSE p END) AS BIGINT) AS total, usable, floor(gain * 1e6 + 0.25) / 1e6 AS gain, floor("offset" * 1e6 + 0.25) / 1e6 AS "offset"
FROM o JOIN p ON o.clip_id = p.clip_id AND o.frame_no = p.frame_no GROUP BY ALL""")
