"""From log-probabilities to scored candidates: reversed inputs, padded and masked; sums of picked scores; a beam's next step. Array functions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reversed_inputs(candidates: DataFrame, group: str, tokens: str, edge: int) -> DataFrame:
    """Adds inputs, targets and valid for a decoder that reads backwards: arrays as long as the group's longest candidate and one more.

    inputs are ``edge`` (start and end alike) and the tokens in reverse, targets the tokens in reverse and ``edge``; both are padded with zeros, where valid is
    false. An empty candidate scores ``edge`` alone. Null candidates, and those that hold a null or a token that isn't over 0 and under ``edge``, have null arrays and don't widen."""
    t = F.col(tokens)
    usable = t.isNotNull() & F.forall(t, lambda x: F.coalesce((x > 0) & (x < edge), F.lit(False)))
    widths = candidates.groupBy(group).agg(F.max(F.when(usable, F.size(t) + 1)).alias("_width"))
    both = candidates.join(widths, group)
    back, end = F.reverse(t), F.array(F.lit(edge))
    padding = F.array_repeat(F.lit(0), F.greatest(F.col("_width") - F.size(t) - 1, F.lit(0)))
    own = lambda a: F.when(usable, F.concat(a, padding))
    valid = F.when(usable, F.concat(F.array_repeat(F.lit(True), F.size(t) + 1), F.transform(padding, lambda x: x != 0)))
    return both.withColumns({"inputs": own(F.concat(end, back)), "targets": own(F.concat(back, end)), "valid": valid}).drop("_width")


def gathered_score(log_probabilities: Column, targets: Column, valid: Column) -> Column:
    """The sum, over valid places, of the log-probability (a row of the vocabulary for each place) of the target. Null if a valid place's isn't there or isn't finite."""
    picked = F.zip_with(log_probabilities, targets, lambda row, t: F.get(row, t.cast("int")))
    masked = F.zip_with(picked, valid, lambda x, v: F.when(F.coalesce(v, F.lit(False)), F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)).otherwise(0.0))
    return F.when(F.size(valid) <= F.size(log_probabilities), F.aggregate(F.slice(masked, 1, F.size(valid)), F.lit(0.0), lambda s, x: s + x))


def beam_step(hypotheses: DataFrame, scores: DataFrame, beam: int, ratio: float = 1.5) -> DataFrame:
    """(utterance, place, hypothesis, token, score): the ``beam`` best continuations over all hypotheses and tokens of an utterance.

    ``hypotheses`` are (utterance, hypothesis, score), ``scores`` (utterance, hypothesis, token, first, full). Of each hypothesis int(ratio * beam) tokens go on,
    the best by first; of these the best by the hypothesis' score and full. Ties go to the smaller hypothesis, then token; a null or NaN score is none. The product
    is never sorted: both levels are limits of groups, which Spark applies before it shuffles; a continuation that isn't in its hypothesis' own best ``beam`` can't be in all's."""
    real = scores.where("first is not null and full is not null and not isnan(first) and not isnan(full)")
    short = real.withColumn("_n", F.row_number().over(Window.partitionBy("utterance", "hypothesis").orderBy(F.desc("first"), "token"))).where(F.col("_n") <= int(ratio * beam))
    both = short.join(hypotheses.where("score is not null and not isnan(score)").withColumnRenamed("score", "_so_far"), ["utterance", "hypothesis"]).withColumn("score", F.col("_so_far") + F.col("full"))
    own = both.withColumn("_n", F.row_number().over(Window.partitionBy("utterance", "hypothesis").orderBy(F.desc("score"), "token"))).where(F.col("_n") <= beam)
    best = own.withColumn("place", F.row_number().over(Window.partitionBy("utterance").orderBy(F.desc("score"), "hypothesis", "token"))).where(F.col("place") <= beam)
    return best.select("utterance", "place", "hypothesis", "token", "score")


def resume_issues(rows: DataFrame) -> DataFrame:
    """(run, step, issue): what of a training run's checkpoints (run, step, epoch, identity, elapsed, budget) forbids going on from them, in the order of ``step``.

    identity: another one than the run began with; start: the first epoch isn't 1; gap: an epoch that doesn't follow the last new one; repeat: one that was there before;
    back: elapsed is less than before (it is carried on, never begun again); overdrawn: more than the budget; clock: null, negative or not finite. Epochs are islands:
    an epoch follows if it is one more than the greatest so far, so a repeat opens no second gap. Nulls of epoch are gaps; a null identity is its own."""
    before = Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("identity").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    good = ~F.isnan("elapsed") & (F.col("elapsed") >= 0) & (F.col("elapsed") < float("inf"))
    marked = rows.withColumns({"_greatest": F.max("epoch").over(before), "_rows": F.count(F.lit(1)).over(before), "_first": first, "_used": F.max(F.when(good, F.col("elapsed"))).over(before), "_there": F.count(F.lit(1)).over(Window.partitionBy("run", "epoch").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))})
    follows = F.coalesce(F.col("epoch") == F.coalesce(F.col("_greatest"), F.lit(0)) + 1, F.lit(False))
    seen = (F.col("_there") > 0) & F.col("epoch").isNotNull()
    begins = F.col("_rows") == 0
    checks = {
        "identity": ~F.col("identity").eqNullSafe(F.col("_first")), "start": begins & ~follows, "repeat": seen, "gap": ~begins & ~seen & ~follows, "clock": ~F.coalesce(good, F.lit(False)),
        "back": good & (F.col("elapsed") < F.col("_used")), "overdrawn": good & (F.greatest(F.col("elapsed"), F.coalesce("_used", F.lit(0.0))) > F.col("budget")),
    }
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))
    return marked.select("run", "step", F.explode(found).alias("issue"))


def archive_members(members: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, status, member, n): the archive member (``members``: name) that each row of ``wanted`` (id, paths) names: missing, one or several.

    A name fits if it is one of the paths or ends with / and one of them. Each name is exploded into its ends behind every /, so the ends meet the paths in an equal join;
    only ends that someone wants are joined on. Equal names are one member; null, empty and missing paths fit nothing."""
    names = members.where("name is not null").select("name").distinct()
    parts = F.split("name", "/")
    ends = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("end"))
    paths = wanted.select("id", F.explode("paths").alias("end")).where("end <> ''").distinct()
    hits = paths.join(ends, "end").select("id", "name").distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("name").alias("member"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "missing").when(n == 1, "one").otherwise("several")
    return wanted.select("id").distinct().join(hits, "id", "left").select("id", status.alias("status"), F.when(n == 1, F.col("member")).alias("member"), n.cast("long").alias("n"))
