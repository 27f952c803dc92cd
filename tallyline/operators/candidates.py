"""n-best lists in long form: scores of every rank, oracles, margins, diversity, rescoring, routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.edit import PIECE, long_distance
from .scoring import ratio


def exploded(df: DataFrame, hypotheses: str = "hypotheses") -> DataFrame:
    """A row per candidate, ranks from 1; a row without candidates has its raw text as the only one."""
    fallback = F.array(F.struct(F.col("raw").alias("text"), F.lit(None).cast("double").alias("score")))
    own = F.when(F.coalesce(F.size(hypotheses), F.lit(0)) > 0, F.col(hypotheses)).otherwise(fallback)
    return df.select("*", F.posexplode(own).alias("pos", "h")).select(*(c for c in df.columns if c != hypotheses), (F.col("pos") + 1).alias("rank"), F.col("h.text").alias("text"), F.col("h.score").alias("score"))


def oracle_at(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Pooled oracle errors at each k, from rows (sample_id, rank, errors, characters): the best of the first k, earliest rank first."""
    w = Window.partitionBy("sample_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = ranked.withColumn("best", F.min("errors").over(w)).withColumn("top", F.max("rank").over(Window.partitionBy("sample_id")))
    at = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") == F.least("k", "top"))
    return at.groupBy("k").agg(F.count("*").alias("samples"), F.sum("best").alias("errors"), F.sum("characters").alias("characters"), ratio(F.sum("best"), F.sum("characters")).alias("cer"))


def best_rank(ranked: DataFrame) -> DataFrame:
    """The earliest rank with the fewest errors of each sample."""
    return ranked.groupBy("sample_id").agg(F.min_by("rank", F.struct("errors", "rank")).alias("rank"), F.min("errors").alias("errors"))


def distinct_texts(ranked: DataFrame, key: Column, most: int | None = None) -> DataFrame:
    """The first rank of each distinct canonical text; empty ones go; the first ``most`` of a sample, renumbered."""
    first = ranked.withColumn("key", key).where("key <> ''").groupBy("sample_id", "key").agg(F.min("rank").alias("rank"), F.min_by("text", "rank").alias("text"))
    out = first.withColumn("place", F.row_number().over(Window.partitionBy("sample_id").orderBy("rank")))
    return out.where(F.col("place") <= most) if most else out


def margins(ranked: DataFrame) -> DataFrame:
    """Normalised score of the first rank less that of the second; null without two finite ones."""
    norm = F.col("score") / F.greatest(F.col("tokens"), F.lit(1))
    first, second = (F.max(F.when(F.col("rank") == r, norm)) for r in (1, 2))
    return ranked.groupBy("sample_id").agg((first - second).alias("margin"))


#: Texts of a list in a block; a task of the pairs has at most this many on each side from one list.
PAIR_ROWS = 256


def _text_pairs(ranked: DataFrame, key: Column) -> DataFrame:
    """(sample_id, rank, key, rank2, key2): the pairs rank < rank2 of the distinct texts of each list.

    A list is cut into blocks by a hash of the rank, and its pairs are dealt by pairs of blocks: a long list, whose pairs
    are all wanted, is many tasks of at most about PAIR_ROWS x PAIR_ROWS pairs."""
    own = distinct_texts(ranked, key).select("sample_id", "rank", "key")
    blocks = own.groupBy("sample_id").agg(F.ceil(F.count("*") / F.lit(PAIR_ROWS)).cast("long").alias("blocks"))
    own = own.join(blocks, "sample_id").withColumn("block", F.pmod(F.xxhash64("rank"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    a = own.select("sample_id", "rank", "key", F.col("block").alias("i"), other.alias("j"))
    b = own.select("sample_id", F.col("rank").alias("rank2"), F.col("key").alias("key2"), other.alias("i"), F.col("block").alias("j"))
    return a.join(b, ["sample_id", "i", "j"]).where("rank < rank2").select("sample_id", "rank", "key", "rank2", "key2")


def diversity(ranked: DataFrame, key: Column) -> DataFrame:
    """(sample_id, pairs, mean_distance): edit distances between the distinct texts of each list, divided by the longer one."""
    pairs = _text_pairs(ranked, key)
    apart = long_distance("key", "key2")
    return pairs.groupBy("sample_id").agg(F.count("*").alias("pairs"), F.avg(apart / F.greatest(F.length("key"), F.length("key2"), F.lit(1))).alias("mean_distance"))


def medoids(ranked: DataFrame, key: Column) -> DataFrame:
    """The ranks of each list whose mean distance to the others is least (within 1e-12)."""
    apart = _text_pairs(ranked, key).select("sample_id", long_distance("key", "key2").cast("double").alias("d"), F.explode(F.array("rank", "rank2")).alias("rank"))
    means = apart.groupBy("sample_id", "rank").agg(F.avg("d").alias("mean"))
    least = means.groupBy("sample_id").agg(F.min("mean").alias("least"))
    return means.join(least, "sample_id").where("mean <= least + 1e-12").select("sample_id", "rank")


def rescored(ranked: DataFrame, score: Column) -> DataFrame:
    """The list in the order of a new score, ties by the old rank."""
    return ranked.withColumn("new_score", score).withColumn("new_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("new_score"), "rank")))


def reverse_score(ctc: float, weight: float) -> Column:
    """score + (1 - ctc) * weight * (reverse - forward); the old score where that changes nothing or an end was forced."""
    if weight == 0 or ctc == 1:
        return F.col("score")
    return F.when(F.col("any_forced"), F.col("score")).otherwise(F.col("score") + (1 - ctc) * weight * (F.col("reverse") - F.col("forward")))


def near_ties(ranked: DataFrame, least: float = 1e-3) -> DataFrame:
    """(sample_id, fallback): whether neighbouring scores of a list are nearer than ``least``."""
    gap = F.col("score") - F.lead("score").over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "rank"))
    return ranked.withColumn("_gap", gap).groupBy("sample_id").agg(F.coalesce(F.min("_gap") < least, F.lit(False)).alias("fallback"))


def _repetitive(tokens: pa.Array) -> np.ndarray:
    """``repetitive`` of a few rows at once, with tokens as numbers in one array.

    Copies that cover 0.6 of a row cover its middle: there, each token equals the one ``w`` before or after, for one ``w``. Only rows where that holds are read again."""
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    out, flat = np.zeros(len(n), bool), pc.list_flatten(tokens)
    ids = pc.dictionary_encode(flat, null_encoding="encode").indices.to_numpy()
    if not len(ids):
        return out
    known, own = flat.is_valid().to_numpy(zero_copy_only=False), np.flatnonzero(n)
    size = n[own]
    starts = np.cumsum(size) - size
    # all that isn't the row's first token is one other token
    apart = ids != np.repeat(ids[starts], size)
    other = np.maximum.reduceat(np.where(apart, ids, -1), starts)
    found = (size >= 6) & ~np.logical_or.reduceat(apart & (ids != np.repeat(other, size)), starts)
    for w in range(3, 13):
        rows = np.flatnonzero(~found & (size >= 12) & (3 * w <= size))
        for at in (-1, 0, 1):
            p = starts[rows] + size[rows] // 2 + at * (size[rows] // 12)
            rows = rows[(ids[p] == ids[p - w]) | (ids[p] == ids[p + w])]
        for r in rows:
            t, k = ids[starts[r] : starts[r] + size[r]], known[starts[r] : starts[r] + size[r]]
            # whether a token repeats the one w before; a run of m such tokens is a phrase said m / w + 1 times in whole
            breaks = np.flatnonzero(~((t[w:] == t[:-w]) & k[w:]))
            run = np.diff(np.concatenate([[-1], breaks, [size[r] - w]])).max() - 1
            found[r] = (run // w + 1) * w >= max(3 * w, 0.6 * size[r])
    out[own] = found
    return out


@F.arrow_udf(T.BooleanType())
def repetitive(tokens: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """At most 2 distinct tokens of 6 or more, or a phrase of 3 to 12 tokens said three times or more in a row, whole copies covering 0.6 of 12 or more."""
    for batch in tokens:
        for at in range(0, len(batch), PIECE):
            yield pa.array(_repetitive(batch.slice(at, PIECE)))


def quality_problem(df: DataFrame) -> Column:
    """The first capture problem in order, or null: face, mouth size, light, contrast, values that aren't finite."""
    bad = F.lit(False)
    for c in ("face_ratio", "mouth_pixels", "brightness", "contrast"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, "not_finite").when(F.col("face_ratio") < 0.7, "face").when(F.col("mouth_pixels") < 35, "mouth").when(~F.col("brightness").between(35, 225), "light").when(F.col("contrast") < 8, "contrast")


def routed(problem: Column, text: Column, is_repetitive: Column, han: Column, margin: Column, agreement: Column, policy: str, min_margin: float) -> Column:
    """retry, review or auto; the order of the tests is the order of the answers."""
    retry = problem.isNotNull() | (F.trim(text) == "") | F.contains(text, F.lit("<unk>")) | is_repetitive
    auto = F.lit(policy == "auto") & F.coalesce(margin >= min_margin, F.lit(False)) & F.coalesce(agreement, F.lit(False))
    return F.when(retry, "retry").when(han, "review").when(auto, "auto").otherwise("review")


def error_counts(rows: DataFrame, key: str) -> DataFrame:
    """All substitutions, deletions and insertions of rows with an alignment: how often, and the first occurrence, in the order of ``key``."""
    ops = rows.select(F.col(key).alias("row"), F.posexplode("alignment.ops").alias("at", "o"))
    return ops.groupBy("o.op", "o.ref", "o.hyp").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("first"))


def error_operations(rows: DataFrame, key: str, most: int = 30) -> DataFrame:
    """The ``most`` commonest of ``error_counts`` of each kind; ties by the first occurrence."""
    return error_counts(rows, key).withColumn("place", F.row_number().over(Window.partitionBy("op").orderBy(F.desc("n"), "first"))).where(F.col("place") <= most).drop("first")


def unknown_characters(rows: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """Characters that the vocabulary lacks, with occurrences and rows."""
    chars = rows.select("sample_id", F.explode(F.split(F.col(text), "")).alias("character")).where("character <> ''")
    return chars.join(vocabulary.select("character").distinct(), "character", "left_anti").groupBy("character").agg(F.count("*").alias("occurrences"), F.countDistinct("sample_id").alias("rows"))
