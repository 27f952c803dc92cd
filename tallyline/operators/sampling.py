"""Deterministic samples: ranks by hash, round robin over groups, seeded splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def round_robin(df: DataFrame, group: str, item: str, groups: int, n: int, seed: int) -> DataFrame:
    """``n`` rows of ``groups`` groups: groups ranked by sha256('seed:group'), items of a group by sha256('seed:item'), taken round by round.

    Only the first n items of a group can be taken, so each group keeps those before anything is ranked over all."""
    tag = lambda c: F.sha2(F.concat(F.lit(f"{seed}:"), F.col(c).cast("string")), 256)
    chosen = df.select(group).distinct().withColumn("_gh", tag(group)).orderBy("_gh").limit(groups)
    chosen = chosen.withColumn("_rank", F.row_number().over(Window.orderBy("_gh")))  # ``groups`` rows
    own = df.join(F.broadcast(chosen), group).withColumn("_ih", tag(item))
    ranked = own.withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy("_ih", item))).where(F.col("round") <= n)
    return ranked.orderBy("round", "_rank").limit(n).withColumn("place", F.row_number().over(Window.orderBy("round", "_rank"))).drop("_gh", "_ih", "_rank")


def first_by_hash(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The n items of each group with the smallest sha256."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.col(item).cast("string"), 256), item)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def held_out(df: DataFrame, item: str, n: int, seed: int = 1) -> DataFrame:
    """The n items with the smallest seeded hashes are the test split, each with all of its rows; a null item is in training."""
    tag = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")), 256)
    test = df.where(F.col(item).isNotNull()).select(item).distinct().withColumn("_h", tag).orderBy("_h", item).limit(n).select(item, F.lit("test").alias("part"))
    return df.join(test, item, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def latest(df: DataFrame, name: str, keep: int) -> DataFrame:
    """The last ``keep`` names in order."""
    return df.orderBy(F.desc(name)).limit(keep)


def first_wins(df: DataFrame, text: str, order: str, least_words: int = 2) -> DataFrame:
    """Distinct texts letter case aside, the first of each, of at least so many words."""
    w = Window.partitionBy(F.lower(F.col(text))).orderBy(order)
    return df.where(F.size(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda x: x != "")) >= least_words).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pending(prompts: DataFrame, saved: DataFrame, norm) -> DataFrame:  # noqa: ANN001
    """Prompts whose normalised reference isn't saved yet."""
    key = norm(F.col("reference"))
    return prompts.withColumn("_k", key).join(saved.select(key.alias("_k")).distinct(), "_k", "left_anti").drop("_k")
