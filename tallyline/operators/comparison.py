"""Two results over the same samples: 1:1 pairing, identity checks, deltas, cluster bootstrap, cohorts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import ratio


def unpaired(baseline: DataFrame, candidate: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, side): samples that only one of the two results has."""
    a, b = (df.select(key, F.lit(1).alias(s)).distinct() for df, s in ((baseline, "_a"), (candidate, "_b")))
    both = a.join(b, key, "full_outer")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "unexpected").otherwise("missing").alias("side"))


def mismatches(baseline: DataFrame, candidate: DataFrame, required: list[str], declared: list[str], key: str = "sample_id") -> DataFrame:
    """(key, field): required fields must be equal (null isn't); declared ones may both be absent."""
    b = candidate.select(key, *(F.col(c).alias(f"b_{c}") for c in (*required, *declared)))
    wrong = [F.when(~F.coalesce(F.col(c) == F.col(f"b_{c}"), F.lit(False)), F.lit(c)) for c in required]
    wrong += [F.when(~F.col(c).eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in declared]
    return baseline.join(b, key).select(key, F.explode(F.array_compact(F.array(*wrong))).alias("field"))


def paired(baseline: DataFrame, candidate: DataFrame, keep: list[str], key: str = "sample_id") -> DataFrame:
    """One row a sample with both results' errors (a_errors, b_errors, a_exact, b_exact)."""
    a = baseline.select(key, "characters", *keep, F.col("errors").alias("a_errors"), F.col("exact").alias("a_exact"))
    return a.join(candidate.select(key, F.col("errors").alias("b_errors"), F.col("exact").alias("b_exact")), key)


def deltas(pairs: DataFrame, *by: str) -> DataFrame:
    """Pooled CER of both and the difference in points; the denominator is the baseline's."""
    out = pairs.groupBy(*by).agg(F.count("*").alias("samples"), F.sum("characters").alias("characters"), F.sum("a_errors").alias("a_errors"), F.sum("b_errors").alias("b_errors"), F.count_if("a_exact").alias("a_exact"), F.count_if("b_exact").alias("b_exact"))
    a, b = (ratio(F.col(f"{x}_errors"), F.col("characters")) for x in "ab")
    return out.withColumns({"a_cer": a, "b_cer": b, "delta_pp": 100 * (b - a)})


def cluster_bootstrap(pairs: DataFrame, cluster: str = "speaker", draws: int = 5000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """One row: the percentile interval of the pooled difference in points when whole clusters are drawn with replacement.

    Clusters become one row of sums each; draws are dealt out over tasks by number, and each task makes its own draws from
    the cluster sums (a draw's generator is seeded by seed and number, so the result doesn't depend on the partitioning).
    Fewer than two clusters have no interval."""
    sums = pairs.groupBy(cluster).agg(F.sum("characters").alias("c"), F.sum(F.col("b_errors") - F.col("a_errors")).alias("d")).orderBy(cluster)
    table = sums.toPandas()  # a row a cluster: speakers, not samples
    spark = pairs.sparkSession
    if len(table) < 2:
        return spark.createDataFrame([(len(table), None, None, None)], "clusters int, low double, high double, mean double")
    held = spark.sparkContext.broadcast((table["c"].to_numpy(float), table["d"].to_numpy(float)))

    def run(batches):  # noqa: ANN001, ANN202
        chars, diff = held.value
        for batch in batches:
            found = []
            for i in batch["id"]:
                at = np.random.default_rng([seed, int(i)]).integers(0, len(chars), len(chars))
                total = chars[at].sum()
                found.append(100 * diff[at].sum() / total if total else None)
            yield pd.DataFrame({"v": found})

    tail = (1 - level) / 2
    return spark.range(draws).mapInPandas(run, "v double").agg(F.lit(len(table)).alias("clusters"), F.percentile("v", tail).alias("low"), F.percentile("v", 1 - tail).alias("high"), F.avg("v").alias("mean"))


def cohorts(pairs: DataFrame, dimensions: dict[str, list[str] | None]) -> DataFrame:
    """Deltas of every value of every dimension, in one pass; declared values (a list) appear even when they are empty."""
    spark = pairs.sparkSession
    long = pairs.withColumn("_v", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions))))
    found = deltas(long.select("*", "_v.dimension", "_v.value").drop("_v"), "dimension", "value")
    declared = [(d, v) for d, values in dimensions.items() for v in values or []]
    if not declared:
        return found
    wanted = spark.createDataFrame(declared, "dimension string, value string")
    all_ = found.join(F.broadcast(wanted.withColumn("_w", F.lit(1))), ["dimension", "value"], "full_outer").drop("_w")
    return all_.fillna(0, ["samples", "characters", "a_errors", "b_errors", "a_exact", "b_exact"])


def named_cohorts(pairs: DataFrame, targets: dict[str, Column]) -> DataFrame:
    """Deltas of overlapping cohorts: each is a condition, and a row may be in several."""
    labels = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in targets.items())))
    return deltas(pairs.withColumn("cohort", F.explode(labels)), "cohort")
