"""Frames as arrays of pixels (0 to 255): quantiles, stabilisation, stress, quality. All in array functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stabilisation:
    strength: float = 0.5
    max_gain: float = 1.5
    max_offset: float = 24.0
    min_brightness: float = 20.0
    max_brightness: float = 235.0
    min_contrast: float = 8.0
    max_saturated: float = 0.2


def quantile(values: Column, q: float) -> Column:
    """Linearly interpolated quantile of an array."""
    s = F.array_sort(values)
    at = F.lit(q) * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low).cast("double"), F.get(s, F.least(low + 1, F.size(values) - 1)).cast("double")
    return _weighted(a, b, at - low)


def _weighted(a: Column, b: Column, part: Column) -> Column:
    """a * (1 - part) + round(b * part), rounded once, as SQL's quantiles have it (a fused multiply and add): cuts of what is made of it tell the last place.

    The first product is split into two that are exact (a has 26 bits at most), and what the sum's rounding drops is added again."""
    x, c = 1 - part, b * part
    big = x * 134217729.0
    high = big - (big - x)
    first, rest = a * high, a * (x - high)
    total = first + c
    back = total - first
    return total + ((first - (total - back)) + (c - back) + rest)


def saturated(values: Column) -> Column:
    return F.size(F.filter(values, lambda p: (p == 0) | (p == 255))) / F.size(values)


def stabilised(frames: DataFrame, config: Stabilisation) -> DataFrame:
    """(clip_id, frame_no, pixels, usable): each usable frame's median and contrast drawn towards the clip's medians, within bounds."""
    f = frames.withColumns({"brightness": quantile(F.col("pixels"), 0.5).cast("double"), "contrast": (quantile(F.col("pixels"), 0.9) - quantile(F.col("pixels"), 0.1)).cast("double")})
    usable = F.col("brightness").between(config.min_brightness, config.max_brightness) & (F.col("contrast") >= config.min_contrast) & (saturated(F.col("pixels")) <= config.max_saturated)
    f = f.withColumn("usable", usable)
    clip = f.where("usable").groupBy("clip_id").agg(F.percentile("brightness", 0.5).alias("_tb"), F.percentile("contrast", 0.5).alias("_tc"))
    f = f.join(clip, "clip_id", "left")
    gain = 1 + config.strength * (F.greatest(F.lit(1 / config.max_gain), F.least(F.lit(config.max_gain), F.col("_tc") / F.col("contrast"))) - 1)
    f = f.withColumn("gain", F.when(F.col("usable"), gain).otherwise(1.0))
    offset = config.strength * F.greatest(F.lit(-config.max_offset), F.least(F.lit(config.max_offset), F.col("_tb") - F.col("gain") * F.col("brightness")))
    f = f.withColumn("offset", F.when(F.col("usable"), offset).otherwise(0.0))
    new = F.transform("pixels", lambda p: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(p * F.col("gain") + F.col("offset")).cast("int"))))
    return f.select("clip_id", "frame_no", F.when(F.col("usable"), new).otherwise(F.col("pixels")).alias("pixels"), "usable", "gain", "offset")


def exposed(frames: DataFrame, amplitude: float, period: float) -> DataFrame:
    """Synthetic stress: brightness swings with the frame's number."""
    swing = F.lit(amplitude) * F.sin(2 * 3.141592653589793 * F.col("frame_no") / period)
    return frames.withColumn("pixels", F.transform("pixels", lambda p: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(p + swing).cast("int")))))


def quality(frames: DataFrame) -> DataFrame:
    """(clip_id, mean_brightness, frame_brightness_std, pixel_contrast_std, saturated_fraction), deviations of the population."""
    total = lambda g: F.aggregate(F.transform("pixels", g), F.lit(0.0), lambda a, x: a + x)
    f = frames.withColumns({"_n": F.size("pixels"), "_s": total(lambda p: p.cast("double")), "_q": total(lambda p: (p * p).cast("double")), "_x": saturated(F.col("pixels")) * F.size("pixels")})
    n, s, q = F.sum("_n"), F.sum("_s"), F.sum("_q")
    return f.groupBy("clip_id").agg(F.avg(F.col("_s") / F.col("_n")).alias("mean_brightness"), F.stddev_pop(F.col("_s") / F.col("_n")).alias("frame_brightness_std"), F.sqrt(F.greatest(F.lit(0.0), q / n - (s / n) * (s / n))).alias("pixel_contrast_std"), (F.sum("_x") / n).alias("saturated_fraction"))


def normalised(values: Column, side: int, crop: int, mean: float = 0.421, deviation: float = 0.165) -> Column:
    """The centre crop of a square image, scaled to (x / 255 - mean) / deviation."""
    edge = (side - crop) // 2
    rows = F.flatten(F.transform(F.sequence(F.lit(edge), F.lit(edge + crop - 1)), lambda r: F.slice(values, r * side + edge + 1, F.lit(crop))))
    return F.transform(rows, lambda p: (p / 255.0 - mean) / deviation)


def changed_frames(before: DataFrame, after: DataFrame) -> DataFrame:
    b = after.select("clip_id", "frame_no", F.col("pixels").alias("_p"))
    return before.join(b, ["clip_id", "frame_no"]).groupBy("clip_id").agg(F.count_if(F.col("pixels") != F.col("_p")).alias("changed"))


def brightness_trend(frames: DataFrame) -> DataFrame:
    """Each frame's mean next to the clip's mean so far."""
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, p: a + p) / F.size("pixels")
    return frames.select("clip_id", "frame_no", mean.alias("mean")).withColumn("so_far", F.avg("mean").over(Window.partitionBy("clip_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0)))
