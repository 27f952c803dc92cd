"""Evidence around results: sidecars, vocabularies, entities, costs, hypotheses' flags, budgets, routing of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import ratio


def with_sidecar(rows: DataFrame, sidecar: DataFrame, defaults: dict[str, str], key: str = "sample_id") -> DataFrame:
    """Rows with their sidecar fields, or the defaults."""
    joined = rows.join(sidecar.select(key, *(F.col(c).alias(f"_{c}") for c in defaults)), key, "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in defaults.items()))


def uncovered(manifest: DataFrame, report: DataFrame, key: str = "sample_id") -> DataFrame:
    """Manifest rows that a report has no row for."""
    return manifest.join(report.select(key).distinct(), key, "left_anti").select(key)


def shared_across(df: DataFrame, keys: list[str], role: str) -> DataFrame:
    """(key, value, roles): values that more than one role has, one grouping for all keys."""
    long = df.select(role, F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))).alias("x")).select(role, "x.*")
    return long.where("value is not null and value <> ''").groupBy("key", "value").agg(F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles")).where(F.contains("roles", F.lit(",")))


def vocabulary_coverage(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tokens, known, coverage) over distinct tokens; unknown ones would be <unk>."""
    known = vocabulary.select("token").distinct().withColumn("_k", F.lit(1))
    return tokens.select("token").distinct().join(known, "token", "left").agg(F.count("*").alias("tokens"), F.count("_k").alias("known"), ratio(F.count("_k"), F.count("*")).alias("coverage"))


def charged(rows: DataFrame, costs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Processing times with each sample's preparation cost added; samples without one cost nothing more."""
    return rows.join(costs.select(key, F.col("seconds").alias("_s")), key, "left").withColumn("processing_seconds", F.col("processing_seconds") + F.coalesce("_s", F.lit(0.0))).drop("_s")


def entity_cohorts(rows: DataFrame, entities: str) -> DataFrame:
    """Pooled errors by entity kind; a row with several kinds is in several cohorts, one without any in ``none``."""
    kinds = F.when(F.coalesce(F.size(entities), F.lit(0)) > 0, F.array_distinct(F.transform(entities, lambda e: e["kind"]))).otherwise(F.array(F.lit("none")))
    return rows.withColumn("kind", F.explode(kinds)).groupBy("kind").agg(F.count("*").alias("samples"), F.sum("errors").alias("errors"), ratio(F.sum("errors"), F.sum("characters")).alias("cer"))


def sdi_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Substitutions, deletions, insertions, and the ratio of lengths, from alignments."""
    a = lambda c: F.sum(f"alignment.{c}")
    ref = a("matches") + a("substitutions") + a("deletions")
    return rows.groupBy(*by).agg(F.count("*").alias("samples"), a("substitutions").alias("substitutions"), a("deletions").alias("deletions"), a("insertions").alias("insertions"), ratio(a("matches") + a("substitutions") + a("insertions"), ref).alias("length_ratio"), ratio(ref, F.count("*")).alias("mean_reference"))


def audit_counters(rows: DataFrame, rules: dict[str, Column], *by: str) -> DataFrame:
    """How many rows of each group break each rule, in one pass."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(r, F.lit(True))).alias(n) for n, r in rules.items()))


def choices(cleanup: Column, raw: Column, alternatives: Column, most: int = 3) -> Column:
    """The first distinct texts of cleanup, raw and alternatives."""
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(cleanup, raw), alternatives))), 1, most)


def spoken_rejections(segments: Column) -> Column:
    """Why a recognition of segments is rejected, or null; the order is the order of the tests."""
    some = lambda p: F.exists(segments, p)
    return F.when(F.size(segments) == 0, "empty").when(some(lambda s: s["avg_logprob"] < -0.85), "logprob").when(some(lambda s: s["no_speech"] > 0.4), "no_speech").when(some(lambda s: s["compression"] > 2.4), "compression").when(some(lambda s: s["text"].rlike(r"(.{2,20})\1{3,}")), "repetition")


def heard_score(segments: Column) -> Column:
    """Sum of log probability times tokens over segments that hold speech."""
    kept = F.filter(segments, lambda s: (s["no_speech"] <= 0.6) & ~F.isnan(s["avg_logprob"]))
    return F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["avg_logprob"] * s["tokens"])


def eligible(rows: DataFrame, units: str, vocabulary: list[str]) -> tuple[DataFrame, DataFrame]:
    """(eligible, excluded): rows whose target isn't empty and has no unit that the vocabulary lacks; the excluded carry theirs."""
    missing = F.array_sort(F.array_except(F.col(units), F.array(*map(F.lit, vocabulary))))
    marked = rows.withColumn("unsupported", missing)
    fine = (F.size("unsupported") == 0) & (F.size(units) > 0)
    return marked.where(fine).drop("unsupported"), marked.where(~fine)


def budgeted(reads: DataFrame, cap: int) -> DataFrame:
    """Byte reads in order with the running total, and whether each still fits the cap."""
    w = Window.partitionBy("source").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return reads.withColumn("total", F.sum("bytes").over(w)).withColumn("within", F.col("total") <= cap)


def token_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """Right tokens of those that the mask counts."""
    right = F.sum(F.when((F.col("mask") == 1) & (F.col("predicted") == F.col("gold")), 1).otherwise(0))
    return rows.groupBy(*by).agg(right.alias("right"), F.sum("mask").alias("counted"), ratio(right, F.sum("mask")).alias("accuracy"))


def forced_ends(ranked: DataFrame) -> DataFrame:
    """Candidates marked as forced, reported otherwise, and not reported at all."""
    return ranked.agg(F.count_if(F.col("forced")).alias("marked"), F.count("forced").alias("reported"), F.count_if(F.col("forced").isNull()).alias("unreported"))


def search_route(length: Column, limit: Column, near_tie: Column) -> Column:
    """How an utterance is scored: skipped, batched, or one by one with the reason."""
    return F.when(length == 0, "skipped").when(length > limit, "sequential: workspace").when(F.coalesce(near_tie, F.lit(True)), "sequential: near tie").otherwise("batched")


def asset_state(size: Column, sha: Column, want_size: Column, want_sha: Column) -> Column:
    return F.when(size.isNull(), "missing").when(size != want_size, "invalid_size").when(F.coalesce(sha != want_sha, F.lit(True)), "invalid_hash").otherwise("ready")


def policy(explicit: Column, by_language: Column, legacy: Column, language: Column) -> Column:
    """The policy in force: the given one, else the language's, else the legacy one, else off; Chinese never goes without review."""
    own = F.coalesce(explicit, by_language, legacy, F.lit("off"))
    return F.when((language == "zh") & (own == "auto"), "review").otherwise(own)


def label_digests(rows: DataFrame, label: str) -> DataFrame:
    """Evidence rows: the label gives way to its digest."""
    return rows.withColumn(f"{label}_sha256", F.sha2(F.col(label), 256)).drop(label)
