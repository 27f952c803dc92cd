"""Checks and small measures over rows of recordings, candidates and captures, as columns and grouped frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, compact

SAMPLE_RATE = 16_000


def bad_duration(seconds: Column) -> Column:
    """Whether a duration is given, but isn't a positive finite number."""
    return seconds.isNotNull() & (F.isnan(seconds) | (seconds <= 0) | (seconds == float("inf")))


def source_issue(source: Column, speaker: Column) -> Column:
    """What is wrong with a source id (numbers, M or F, a region, a number) of a speaker, or null."""
    fits = source.rlike(r"^[0-9]+_[0-9]+_[MF]_[A-Z]+_[0-9]+$")
    return F.when(~F.coalesce(fits, F.lit(False)), "form").when(~F.startswith(source, F.concat(speaker, F.lit("_"))), "speaker")


def small_frame(width: Column, height: Column, least: int = 160) -> Column:
    return F.coalesce(F.least(width, height) <= least, F.lit(True))


def blocked_when_synthetic(status: Column, gates: Column, synthetic: Column) -> tuple[Column, Column]:
    """(status, gates): results under synthetic conditions are never ready, and a gate says so."""
    return F.when(synthetic, "not_ready").otherwise(status), F.when(synthetic, F.array_append(gates, F.lit("synthetic_conditions"))).otherwise(gates)


def missing_bytes(state: Column, size: Column) -> Column:
    """Bytes still to be fetched; an aggregate."""
    return F.coalesce(F.sum(F.when(state == "missing", size)), F.lit(0))


def workspace_bytes(frames: Column, beam: int, vocabulary: int, width: int = 4) -> Column:
    """Memory that a beam search needs for six tables of log-probabilities over two states."""
    return (F.lit(6 * 2 * beam * vocabulary * width) * frames).cast("long")


def with_length_bonus(score: Column, tokens: Column, weight: float) -> Column:
    return score + F.lit(weight) * F.size(tokens)


def capture_measures(frames: DataFrame, key: str, width: str, face: str) -> DataFrame:
    """Median mouth width and share of frames with a face, of each clip."""
    return frames.groupBy(key).agg(F.median(width).alias("mouth_width"), F.avg(F.col(face).cast("double")).alias("face_ratio"))


def capped(frames: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """The frames of each clip up to ``seconds`` after its first; the first comes from sums by clip, not from a window over it."""
    first = frames.groupBy(F.col(key).alias("_clip")).agg(F.min(at).alias("_first"))
    return frames.join(first, frames[key] == F.col("_clip")).where(F.col(at) <= F.col("_first") + seconds).drop("_clip", "_first")


def speech(spans: DataFrame, key: str, samples: Column) -> DataFrame:
    """Seconds of speech, and the first and last sample of it, from voice spans [a, b) of each clip; spans are clamped to the clip, empty ones dropped."""
    a, b = F.greatest(F.lit(0), F.col("a")), F.least(samples, F.col("b"))
    inside = spans.withColumns({"a": a, "b": b}).where("a < b")
    return inside.groupBy(key).agg((F.sum(F.col("b") - F.col("a")) / SAMPLE_RATE).alias("seconds"), F.min("a").alias("first"), F.max("b").alias("last"))


def nbest_oracle(samples: DataFrame, candidates: DataFrame, config: str) -> DataFrame:
    """Per configuration the error rate of the best candidates of ``samples`` (config, sample_id, characters); one without candidates costs all of its characters."""
    best = candidates.groupBy(config, "sample_id").agg(F.min("errors").alias("best"))
    both = samples.join(best, [config, "sample_id"], "left")
    return both.groupBy(config).agg((F.sum(F.coalesce("best", "characters")) / F.sum("characters")).alias("cer"))


def already_there(new: DataFrame, manifest: DataFrame, content: str) -> DataFrame:
    """The rows of ``new`` whose content is in the manifest; they must not be appended."""
    return new.join(manifest.select(content).distinct(), content, "left_semi")


def disagreement(ranked: DataFrame, text: Column, least: float = 0.38) -> DataFrame:
    """(sample_id, disagree): whether one of the next two distinct texts differs from the first in over ``least`` of the longer one's characters.

    Texts are compared compact; null and blank ones don't count, one of punctuation alone does (as nothing). A sample of fewer than two texts doesn't disagree."""
    kept = ranked.where(~F.coalesce(text.rlike(rf"(?U)^[{SPACE}]*$"), F.lit(True)))
    rows = kept.select("sample_id", "rank", compact(text).alias("t")).groupBy("sample_id", "t").agg(F.min("rank").alias("rank"))
    by = Window.partitionBy("sample_id").orderBy("rank")
    rows = rows.withColumn("place", F.row_number().over(by)).where("place <= 3")  # three rows of a list at most
    top = rows.where("place = 1").select("sample_id", F.col("t").alias("top"))
    far = F.levenshtein("t", "top") / F.greatest(F.length("t"), F.length("top"), F.lit(1)) > least
    found = rows.join(top, "sample_id").groupBy("sample_id").agg(F.bool_or((F.col("place") > 1) & far).alias("disagree"))
    return ranked.select("sample_id").distinct().join(found, "sample_id", "left").withColumn("disagree", F.coalesce("disagree", F.lit(False)))


def unsupported_units(units: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, unit): the units of each row that the vocabulary lacks; a row without units has one null unit."""
    one = units.select("id", F.explode_outer(F.array_distinct("units")).alias("unit"))
    return one.join(vocabulary.select("unit").distinct(), "unit", "left_anti").select("id", "unit")
