"""Leakage audits: overlaps between splits, intervals of the same recording, exposure, exclusions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_overlaps(df: DataFrame, keys: dict[str, Column], pairs: list[tuple[str, str]], split: str = "split") -> DataFrame:
    """(key, first, second, value): values of a key that two splits share. One grouping by (key, value), no join."""
    long = df.select(split, F.explode(F.array(*(F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in keys.items()))).alias("x")).select(split, "x.*").where("value is not null and value <> ''")
    seen = long.groupBy("key", "value").agg(F.collect_set(split).alias("splits"))
    both = F.array_compact(F.array(*(F.when(F.array_contains("splits", a) & F.array_contains("splits", b), F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))) for a, b in pairs)))
    return seen.select("key", "value", F.explode(both).alias("p")).select("key", "p.first", "p.second", "value")


def overlapping(df: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """(first, second): rows of the same key whose half-open intervals overlap; a null end is open, touching ones don't.

    Rows go into time bins of the key that they cover, so a key that many rows have isn't compared all with all; a pair is
    reported from the bin where the later of the two begins."""
    width = 64.0
    infinite = F.lit(float("inf"))
    span = df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("k"), F.col(start).cast("double").alias("s"), F.coalesce(F.col(end).cast("double"), infinite).alias("e"), F.col(order).alias("i"))
    last = span.groupBy("k").agg(F.floor(F.max("s") / width).alias("top"))  # no pair is told from a later bin
    binned = span.where("e > s").join(last, "k").withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / width), F.greatest(F.floor(F.col("s") / width), F.least(F.col("top"), F.when(F.col("e") < infinite, F.floor(F.col("e") / width)).otherwise(F.col("top")))))))
    a, b = binned.alias("a"), binned.alias("b")
    told = F.floor(F.greatest("a.s", "b.s") / width) == F.col("a.b")
    hit = (F.col("a.k") == F.col("b.k")) & (F.col("a.b") == F.col("b.b")) & (F.col("a.i") < F.col("b.i")) & (F.greatest("a.s", "b.s") < F.least("a.e", "b.e")) & told
    return a.join(b, hit).select(F.col("a.i").alias("first"), F.col("b.i").alias("second"))


def contradictions(df: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys with more than one value of an attribute that must go with them."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(attribute).alias("values")).where("values > 1")


def exposed(test: DataFrame, development: DataFrame, keys: list[str]) -> DataFrame:
    """(sample_id): test rows any of whose keys is in the development rows; a semi join a key, then distinct."""
    return reduce(DataFrame.unionByName, (test.join(development.select(k).distinct(), k, "left_semi").select("sample_id") for k in keys)).distinct()


def exposure(rows: DataFrame, train: DataFrame | None, dev: DataFrame | None, key: str) -> DataFrame:
    """Each row labelled seen, unseen (only if both corpora are given) or unknown."""
    known = [df.select(key) for df in (train, dev) if df is not None]
    if not known:
        return rows.withColumn("exposure", F.lit("unknown"))
    seen = reduce(DataFrame.unionByName, known).distinct().withColumn("_seen", F.lit(True))
    return rows.join(seen, key, "left").withColumn("exposure", F.when(F.col("_seen"), "seen").otherwise("unseen" if len(known) == 2 else "unknown")).drop("_seen")


def excluding(df: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    return df.join(prior.select(key).distinct(), key, "left_anti")


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): the set difference both ways."""
    return a.select(key).subtract(b.select(key)).withColumn("side", F.lit("missing")).unionByName(b.select(key).subtract(a.select(key)).withColumn("side", F.lit("unexpected")))


def blocked(df: DataFrame, hashes: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """Rows on a hash block-list, or whose source string holds a blocked phrase."""
    hit = df.join(hashes.select("sha256").distinct(), "sha256", "left_semi")
    return hit.unionByName(df.where(reduce(lambda x, y: x | y, (F.contains(F.col(text), F.lit(p)) for p in phrases)))).distinct() if phrases else hit
