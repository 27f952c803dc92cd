"""Choosing a configuration under gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gated_choice(results: DataFrame, baseline: str) -> DataFrame:
    """One row: the configuration with the fewest pooled errors of those that beat the baseline in sum and lose in no condition.

    ``results`` has a row per (config, ord, condition) with errors, exact, coverage, failures; ties go to the smaller ord, and
    without an eligible configuration the baseline stays."""
    base = results.where(F.col("config") == baseline).select("condition", *(F.col(c).alias(f"b_{c}") for c in ("errors", "exact", "coverage")))
    joined = results.join(base, "condition", "left")
    fine = (F.col("errors") <= F.col("b_errors")) & (F.col("exact") >= F.col("b_exact")) & (F.col("coverage") >= F.col("b_coverage")) & (F.col("failures") == 0)
    sums = joined.groupBy("config", "ord").agg(F.sum("errors").alias("errors"), F.sum("b_errors").alias("b_errors"), F.bool_and(F.coalesce(fine, F.lit(False))).alias("fine"))
    open_ = sums.withColumn("eligible", F.col("fine") & (F.col("errors") < F.col("b_errors")) & (F.col("config") != baseline))
    best = open_.agg(F.min_by(F.when(F.col("eligible"), F.col("config")), F.when(F.col("eligible"), F.struct("errors", "ord"))).alias("c"), F.count_if("eligible").alias("eligible"))
    return best.select(F.coalesce("c", F.lit(baseline)).alias("config"), "eligible")


def argmin(results: DataFrame, config: str, *by: str) -> DataFrame:
    return results.agg(F.min_by(config, F.struct(*by)).alias(config))


def best_epoch(epochs: DataFrame, baseline_cer: float) -> DataFrame:
    """The earliest epoch with the strictly smallest CER among those better than the baseline; none if there is none."""
    return epochs.where(F.col("cer") < baseline_cer).agg(F.min_by("epoch", F.struct("cer", "epoch")).alias("epoch"), F.min("cer").alias("cer"))


def improvements(epochs: DataFrame) -> DataFrame:
    """Epochs that are strictly better than all before them."""
    before = F.min("cer").over(Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return epochs.withColumn("_b", before).where("_b is null or cer < _b").drop("_b")


def ledger(steps: DataFrame, budget: float) -> DataFrame:
    """Elapsed seconds carried over resumes, and whether a step still fits the budget."""
    total = F.sum("seconds").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return steps.withColumn("elapsed", total).withColumn("within", F.col("elapsed") <= budget)
