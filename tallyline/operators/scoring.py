"""Samples against predictions: pairing with full denominators, row scores, pooled metrics, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edit import distance


def paired_predictions(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every sample with its prediction; of several the one of the highest ``ord`` counts, a missing one is a rejected empty text."""
    last = Window.partitionBy("sample_id").orderBy(F.desc("ord"))
    own = predictions.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "ord").withColumn("_here", F.lit(True))
    joined = samples.join(own, "sample_id", "left")
    return joined.withColumns({"raw": F.coalesce("raw", F.lit("")), "action": F.coalesce("action", F.lit("retry")), "error": F.when(F.col("_here").isNull(), "Missing prediction").otherwise(F.col("error"))}).drop("_here")


def unexpected_predictions(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions of no sample."""
    return predictions.join(samples.select("sample_id"), "sample_id", "left_anti").select("sample_id").distinct()


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many have them."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def scored(rows: DataFrame, key) -> DataFrame:  # noqa: ANN001
    """Row scores. ``key`` normalises a text column; failed and rejected rows keep their whole reference as errors."""
    ref, hyp = key(F.col("reference")), key(F.col("raw"))
    out = rows.withColumns({"ref_key": ref, "hyp_key": hyp})
    offered = (F.col("hyp_key") != "") & (F.col("action") != "retry") & F.col("error").isNull()
    timed = (F.col("duration_seconds") > 0) & (F.col("processing_seconds") >= 0)
    out = out.withColumns({"characters": F.length("ref_key").cast("long"), "offered": offered, "rtf": F.when(timed, F.col("processing_seconds") / F.col("duration_seconds"))})
    out = out.withColumn("errors", F.when(F.col("offered"), distance(F.col("hyp_key"), F.col("ref_key"))).otherwise(F.col("characters")))
    return out.withColumns({"cer": ratio(F.col("errors"), F.col("characters")), "exact": F.col("offered") & (F.col("errors") == 0), "automatic": F.col("offered") & (F.col("action") == "auto")})


def ratio(a: Column, b: Column) -> Column:
    """a / b; null (not 0) for an empty denominator."""
    return F.when(b != 0, a / b)


def pooled(rows: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged metrics of scored rows: sums before ratios, every row in the denominators."""
    flag = lambda c: F.sum(F.col(c).cast("long"))
    auto = F.when(F.col("automatic"), F.col("errors")), F.when(F.col("automatic"), F.col("characters"))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("samples"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("characters"), F.lit(0)).alias("characters"), flag("exact").alias("exact"), flag("offered").alias("offered"), flag("automatic").alias("automatic"),
        F.count("error").alias("failures"), F.sum(auto[0]).alias("auto_errors"), F.sum(auto[1]).alias("auto_characters"), F.percentile("processing_seconds", 0.5).alias("p50"), F.percentile("processing_seconds", 0.95).alias("p95"))
    c = F.col
    return sums.select(
        *by, "samples", "errors", "characters", ratio(c("errors"), c("characters")).alias("cer"), ratio(c("exact"), c("samples")).alias("exact_rate"), ratio(c("offered"), c("samples")).alias("coverage"), (1 - ratio(c("offered"), c("samples"))).alias("rejection"),
        ratio(c("automatic"), c("samples")).alias("automatic_coverage"), ratio(c("auto_errors"), c("auto_characters")).alias("automatic_cer"), "failures", "p50", "p95")


def report_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of a report: references, errors, CER, exact, empty, failures, coverage."""
    empty = F.col("hyp_key") == ""
    return rows.groupBy(*by).agg(
        F.count("*").alias("samples"), F.sum("characters").alias("characters"), F.sum("errors").alias("errors"), ratio(F.sum("errors"), F.sum("characters")).alias("cer"), F.count_if("exact").alias("exact"), F.count_if(empty).alias("empty"), F.count("error").alias("failures"),
        ratio(F.count_if(~empty & F.col("error").isNull()), F.count("*")).alias("coverage"))


def nearest_rank(values: str, q: float, *by: str):  # noqa: ANN201
    """df -> the value at rank min(n - 1, round(q * (n - 1))), rounding half to even; ranks instead of one array a group."""

    def run(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        ranked = df.where(F.col(values).isNotNull()).withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(values)) - 1})
        return ranked.where(F.col("_i") == F.least(F.col("_n") - 1, F.bround(F.lit(q) * (F.col("_n") - 1)).cast("long"))).select(*by, F.col(values).alias("value"))

    return run


def sessions_per_speaker(rows: DataFrame) -> DataFrame:
    """Distinct speakers, and the fewest distinct sessions that any of them has."""
    return rows.groupBy("speaker").agg(F.countDistinct("session").alias("sessions")).agg(F.count("*").alias("speakers"), F.min("sessions").alias("min_sessions"))


@dataclass(frozen=True)
class Thresholds:
    """What a result must reach."""

    samples: int = 50
    speakers: int = 5
    sessions: int = 2
    cer: float = 0.15
    coverage: float = 0.9
    automatic_cer: float = 0.05
    p95: float = 5.0

    def __post_init__(self) -> None:
        if min(self.samples, self.speakers, self.sessions) < 1 or not all(0 <= x <= 1 for x in (self.cer, self.coverage, self.automatic_cer)) or not 0 < self.p95 < float("inf"):
            raise ValueError("thresholds are out of their ranges")


def gates(metrics: DataFrame, limits: Thresholds) -> DataFrame:
    """(criterion, observed, required, passed) rows of one row of metrics; a null observation fails."""
    at_least = {"samples": limits.samples, "speakers": limits.speakers, "min_sessions": limits.sessions, "coverage": limits.coverage}
    at_most = {"cer": limits.cer, "automatic_cer": limits.automatic_cer, "p95": limits.p95}
    rule = lambda c, v, ok: F.struct(F.lit(c).alias("criterion"), F.col(c).cast("double").alias("observed"), F.lit(float(v)).alias("required"), F.coalesce(ok, F.lit(False)).alias("passed"))
    rules = [rule(c, v, F.col(c) >= v) for c, v in at_least.items()] + [rule(c, v, F.col(c) <= v) for c, v in at_most.items()]
    return metrics.select(F.inline(F.array(*rules)))


def word_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Pooled word error rate of rows with edits and words; 0 (not null) when there is nothing."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum("edits"), F.lit(0)).alias("edits"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).withColumn("wer", F.col("edits") / F.greatest("words", F.lit(1)))
