"""Mixing sources to target weights by the cube method.

Sources ascend by code point, null last, and weigh 5, 2, 1, 5, 2, 1, ...; they share all words by weight, no source above
``most_repeats`` times its own size (the excess is reshared by weight). A source's multiplicity m = target / size gives each
of its documents floor(m) whole copies and one more with probability m - floor(m). The flight phase of the cube method moves
those fractional probabilities inside the null space of the balance constraints (sum of probabilities: documents; sum of
size * probability: words) until each is 0 or 1. Sources are cut into blocks by a hash, so a hot source is many tasks; a block
leaves at most two undecided documents, which meet in a next round of far fewer blocks, until one block is left for the
source; a small source lands in the first round, whatever the others do. The landing problem is what the last flight leaves,
two documents, among the smallest where there are many: of their four choices that one is taken whose words come nearest.

Rows that repeat doc_id, source and size (and ``also``) can't be told apart and are units of up to UNIT_ROWS rows, which fly
as one: a unit of c rows has floor(c * p) copies more, and perhaps one. So a hot row is many units, and no task takes them all.

Defined cases: null text has size 0; a null source is a source of its own, last; a source of size 0 takes nothing; rows that
repeat a doc_id are rows of their own; all hashes are of values, so reruns agree; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5.0, 2.0, 1.0)
#: Units of a flight block, and rows of a unit.
BLOCK_ROWS, UNIT_ROWS = 2048, 1024
#: Probabilities this near to 0 or 1 are decided.
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text: word beginnings, without making the words."""
    one = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(one, F.lit("[^ ]++")).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, n (units), and weight by its place; ranks come from range partitions, so many sources need no single task."""
    own = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("source_size"), F.sum(F.ceil(F.col("c") / UNIT_ROWS)).alias("n"))
    placed = written(own.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = placed.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    place = F.pmod(rank, F.lit(len(WEIGHTS)))
    weight = F.lit(WEIGHTS[-1])
    for i, w in enumerate(WEIGHTS[:-1]):
        weight = F.when(place == i, F.lit(w)).otherwise(weight)
    return placed.join(before, "part").select("source", "source_size", "n", weight.alias("weight"))


def targets(sources: DataFrame, most_repeats: float) -> DataFrame:
    """``sources`` with target; each round of resharing is a sum over the sources."""
    cap = most_repeats * F.col("source_size").cast("double")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate = 0.0
    free_weight = sources.agg(F.sum("weight")).first()[0]
    left = float(total)
    while free_weight:
        rate = left / free_weight
        below = cap > F.col("weight") * F.lit(rate)
        capped, free = sources.agg(F.sum(F.when(~below, cap)), F.sum(F.when(below, F.col("weight")))).first()
        if free == free_weight or not free:
            break
        left, free_weight = float(total) - (capped or 0.0), free
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(rate)))


def flight(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities moved to 0 or 1 but for at most two, keeping sum(p) and sum(size * p), and each p in expectation.

    Each step moves along the null space of the two sums: the largest undecided document by itself, all others together by
    the little that makes up for it (the less, the nearer they are to 0 or 1), until one of them is decided. So large
    documents are decided while there are many to balance them, and small ones are left."""
    p = np.where(p <= _NEAR, 0.0, np.where(p >= 1 - _NEAR, 1.0, p))
    order = np.argsort(-size, kind="stable")
    live = order[(p[order] > 0) & (p[order] < 1)]
    s, q, step = size[live].astype(float), p[live], 0
    while len(live) > 2:
        w = np.minimum(q, 1 - q) ** 2
        own = s - (w @ s) / w.sum()  # sizes about their mean: then the two sums are orthogonal
        spread = w @ (own * own)
        for j in range(3):  # the first alone may be unable to move, where all others are of one size
            u = -w * (1 / w.sum() + own * (own[j] / spread if spread > 1e-12 * (w @ (s * s)) else 0.0))
            u[j] += 1.0
            if u[j] > _NEAR:
                break
        else:
            break
        rising, falling = u > 0, u < 0
        room_up, room_down = np.where(rising, 1 - q, q), np.where(rising, q, 1 - q)
        size_u = np.where(rising | falling, np.abs(u), 1e-300)
        ends_up, ends_down = room_up / size_u, room_down / size_u
        i, k = int(ends_up.argmin()), int(ends_down.argmin())
        up, down = ends_up[i], ends_down[k]
        # the draw between the two ends has the odds that keep expectations: the nearer end comes up more often
        if draws[step] * (up + down) < down:
            q, hit = q + up * u, i
        else:
            q, hit = q - down * u, k
        step += 1
        q[hit] = float(q[hit] > 0.5)
        decided = (q <= _NEAR) | (q >= 1 - _NEAR)
        p[live[decided]] = np.round(q[decided])
        live, s, q = live[~decided], s[~decided], q[~decided]
    p[live] = q
    return p


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The landing: of all 0/1 choices of the few undecided documents, the one whose words (then documents) are nearest to what they should make."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(choices @ size[open_].astype(float) - float((size[open_] * p[open_]).sum()))
    docs = np.abs(choices.sum(axis=1) - p[open_].sum())
    p = p.copy()
    p[open_] = choices[np.argmin(words + 0.02 * size[open_].mean() * docs)] if len(open_) else []
    return p


def _fly(divisor: int):  # noqa: ANN202
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="block").sort_values(["h", "size", "c"], kind="stable", ignore_index=True)
        size = rows["size"].to_numpy()
        draws = (rows["h"].to_numpy().view(np.uint64) >> np.uint64(11)) / float(1 << 53)
        p = flight(size, rows["p"].to_numpy(), draws)
        rows["p"] = land(size, p) if rows["n"].iloc[0] <= divisor else p  # the source is one block now
        return rows

    return run


def mixed(docs: DataFrame, most_repeats: float = 3.0, also: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), copies, taken (words that the mix takes of it); and the long column ``also``, which then tells rows apart."""
    tag = F.col(also) if also else F.lit(0)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), tag.cast("long").alias("also"))
    sizes = written(sizes.groupBy("doc_id", "source", "size", "also").agg(F.count("*").alias("c")), "mix-sizes")
    sources = written(targets(ranked_sources(sizes), most_repeats), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-9)
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    sources = sources.withColumns({"whole": whole, "part": F.greatest(F.lit(0.0), ratio - whole), "key": key})
    # units: their number of rows, the copies that these get for sure, and the probability of one more
    units = sizes.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / UNIT_ROWS)))).withColumn("c", F.least(F.lit(UNIT_ROWS).cast("long"), F.col("c") - F.col("unit") * UNIT_ROWS))
    rows = units.withColumn("key", key).join(sources.select("key", "source_size", "target", "whole", "part", "n"), "key")
    rows = rows.withColumn("sure", F.floor(F.col("c") * F.col("part") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("c") * F.col("part") - F.col("sure"))).withColumn("h", F.xxhash64(F.lit("mix"), "doc_id", "size", "also", "unit"))
    shape = "doc_id long, source string, size long, also long, c long, source_size long, target double, whole long, sure long, p double, n long, key long, h long"
    rows = rows.select(*(x.split()[0] for x in shape.split(", ")))
    decided: list[DataFrame] = []
    most = sources.agg(F.max("n")).first()[0] or 0
    divisor = BLOCK_ROWS
    undecided = rows
    while True:
        last = most <= divisor
        # blocks of a source: its units by a hash, about BLOCK_ROWS undecided ones in each
        block = F.pmod(F.xxhash64("h", F.lit(divisor)), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / F.lit(divisor))))
        flown = undecided.withColumn("block", block).groupBy("key", "block").applyInPandas(_fly(divisor), shape)
        flown = written(flown, "mix-flight")
        if last:
            decided.append(flown)
            break
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.where(~open_))
        undecided = flown.where(open_)
        divisor *= BLOCK_ROWS // 2
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    # a unit's rows again: the first ones have the copies beyond the whole ones
    extra = (F.col("sure") + F.round("p")).cast("long")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))))
    copies = F.col("whole") + (F.col("row") <= extra).cast("long")
    found = out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "also")
    return found.withColumnRenamed("also", also) if also else found.drop("also")
