"""Ordered frames: resampling, gaps, smoothing, collapse, placement, session gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resampled(frames: DataFrame, fps: float = 25.0) -> DataFrame:
    """(clip_id, k, frame_no): the nearest frame of each instant t0 + k / fps, ties to the earlier; a clip whose times don't strictly increase keeps its own order.

    Each frame answers the instants between its midpoints with its neighbours, so no instant is joined with any frame."""
    w = Window.partitionBy("clip_id").orderBy("frame_no")
    whole = Window.partitionBy("clip_id")
    f = frames.withColumns({"before": F.lag("ts").over(w), "after": F.lead("ts").over(w), "t0": F.first("ts").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "i": F.row_number().over(w) - 1})
    f = f.withColumn("valid", F.bool_and(F.col("ts").isNotNull() & ~F.isnan("ts") & F.coalesce(F.col("before") < F.col("ts"), F.lit(True))).over(whole))
    scale = lambda t: (t - F.col("t0")) * fps
    # instants after the midpoint with the frame before, up to (and with) the one with the frame after
    low = F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.floor(scale((F.col("before") + F.col("ts")) / 2)) + 1)
    high = F.when(F.col("after").isNull(), F.floor(scale(F.col("ts")) + 1e-6)).otherwise(F.floor(scale((F.col("ts") + F.col("after")) / 2)))
    steps = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    own = f.where("valid").select("clip_id", F.explode(steps).alias("k"), "frame_no")
    return own.unionByName(f.where("not valid").select("clip_id", F.col("i").cast("bigint").alias("k"), "frame_no"))


def filled(frames: DataFrame, value: str) -> DataFrame:
    """Gaps filled by straight lines between known values, and by the nearest one at the ends; a clip without any stays null."""
    w = Window.partitionBy("clip_id").orderBy("frame_no")
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("frame_no").alias("n"), F.col(value).alias("v")))
    f = frames.withColumns({"_l": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    line = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * (F.col("frame_no") - F.col("_l.n")) / (F.col("_r.n") - F.col("_l.n"))
    return f.withColumn("filled", F.coalesce(F.col(value), F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), line), F.col("_l.v"), F.col("_r.v"))).drop("_l", "_r")


def smoothed(frames: DataFrame, value: str, half: int = 6) -> DataFrame:
    """Centred moving average whose half width min(half, i, n - 1 - i) shrinks alike on both sides at the ends.

    Prefix sums at i + m and i - m - 1 by offsets: m takes half + 1 values only."""
    w = Window.partitionBy("clip_id").orderBy("frame_no")
    f = frames.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("clip_id"))})
    m = F.least(F.lit(half), F.col("_i"), F.col("_n") - 1 - F.col("_i"))
    out = F.col(value).cast("double")
    for k in range(1, half + 1):
        out = F.when(m == k, F.avg(value).over(w.rowsBetween(-k, k))).otherwise(out)
    return f.withColumn("smooth", out).drop("_i", "_n")


def carried(frames: DataFrame, value: str) -> Column:
    """The last known value up to each frame."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("clip_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, 0))


def collapsed(steps: DataFrame, value: str, blank=0) -> DataFrame:  # noqa: ANN001
    """Best path: repeats of the step before and blanks go."""
    before = F.lag(value).over(Window.partitionBy("clip_id").orderBy("frame_no"))
    return steps.withColumn("_b", before).where((F.col("_b").isNull() | (F.col("_b") != F.col(value))) & (F.col(value) != blank)).drop("_b")


def rates(frames: DataFrame) -> DataFrame:
    """(clip_id, frames, fps); 0 for a clip without duration."""
    return frames.groupBy("clip_id").agg(F.count("*").alias("frames"), (F.max("ts") - F.min("ts")).alias("d")).select("clip_id", "frames", F.when(F.col("d") > 0, (F.col("frames") - 1) / F.col("d")).otherwise(0.0).alias("fps"))


def clip_problems(frames: DataFrame) -> DataFrame:
    """The first problem of each clip: too short, too few frames, face seldom seen, mouth that hardly moves."""
    s = frames.groupBy("clip_id").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("d"), F.avg(F.col("face").cast("double")).alias("seen"), F.stddev_pop(F.when(F.col("mouth_open") > 0, F.col("mouth_open"))).alias("moves"))
    return s.select("clip_id", F.when((F.col("d") < 0.6) | (F.col("n") < 12), "short").when(F.col("seen") < 0.4, "face").when(F.coalesce(F.col("moves"), F.lit(0.0)) < 0.012, "still").otherwise("ok").alias("problem"))


def joined_sessions(events: DataFrame, gap: float) -> DataFrame:
    """Events numbered by session; one that begins less than ``gap`` seconds after the last (strictly) goes on with its session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce((F.col("seconds") - F.lag("seconds").over(w)) >= gap, F.lit(True))
    return events.withColumn("fresh", fresh).withColumn("session", F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sentences(cues: DataFrame) -> DataFrame:
    """(file, sentence, text, start, end, words): cues joined until one ends in a full stop, ! or ?; 4 to 30 words and under 12 seconds stay."""
    w = Window.partitionBy("file").orderBy("cue")
    ends = F.col("text").rlike(r"[.!?][\"')]*\s*$")
    numbered = cues.withColumn("_e", ends.cast("int")).withColumn("sentence", F.coalesce(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = numbered.groupBy("file", "sentence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))).where(F.col("words").between(4, 30) & (F.col("end") - F.col("start") < 12))


def placed_chunks(chunks: DataFrame, targets: DataFrame, frame: float, least: float = 0.5) -> DataFrame:
    """(clip_id, k, value): the latest chunk that covers each frame of a target; null unless over ``least`` of the frames are covered.

    A chunk covers [t0, t0 + seconds); it goes to the frames that it covers, so nothing is compared all with all. Rows are dealt by clip before they
    become frames, and stay there: frames are never shuffled. A clip has one target; the first of its rows brings the frames without a chunk, too."""
    clip = Window.partitionBy("clip_id")
    c = targets.repartition("clip_id").join(chunks, "clip_id", "left").withColumn("_first", F.row_number().over(clip.orderBy("chunk")) == 1)
    first = F.greatest(F.ceil((F.col("t0") - F.col("start")) / frame), F.lit(0))
    last = F.least(F.ceil((F.col("t0") + F.col("seconds") - F.col("start")) / frame) - 1, F.col("n") - 1)
    low, high = F.when(F.col("_first"), F.lit(0).cast("bigint")).otherwise(first), F.when(F.col("_first"), F.col("n").cast("bigint") - 1).otherwise(last)
    spread = c.withColumns({"first": first, "last": last, "k": F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))})
    out = spread.groupBy("clip_id", "n", "k").agg(F.max_by("value", F.when(F.col("k").between(F.col("first"), F.col("last")), F.col("chunk"))).alias("value"))
    return out.withColumn("_s", F.count("value").over(clip) / F.col("n")).select("clip_id", "k", F.when(F.col("_s") > least, F.col("value")).alias("value"))


def layer_normed(wave: Column, frames: Column, per_frame: int = 640, eps: float = 1e-5) -> Column:
    """A wave cut or filled with zeros to ``per_frame`` samples a frame, less its mean, over the root of its variance (of all samples) and ``eps``.

    Silence stays zeros; no frames, or a null wave, give an empty array, a null sample counts as 0."""
    want = F.greatest(F.coalesce(frames, F.lit(0)) * per_frame, F.lit(0)).cast("int")
    some = F.transform(F.slice(F.coalesce(wave, F.array().cast("array<double>")), F.lit(1), want), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    whole = F.when(wave.isNull(), some).otherwise(F.concat(some, F.array_repeat(F.lit(0.0), want - F.size(some))))
    # a lambda's argument is computed once, an expression inside a lambda for each element
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    centred = lambda a: once(mean(a), lambda m: F.transform(a, lambda x: x - m))
    scaled = lambda a: once(F.sqrt(mean(F.transform(a, lambda x: x * x)) + eps), lambda s: F.transform(a, lambda x: x / s))
    return once(whole, lambda a: F.when(F.size(a) > 0, once(centred(a), scaled)).otherwise(a))
