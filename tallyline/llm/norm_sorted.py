"""Exact top-k inner products over integer vectors, by descending length with bounds that skip most products.

Components become ``floor(scale * x)``, so scores are exact 64-bit integers. Candidates are dealt into slices by descending
length; within a slice a task goes on by descending length, too. Two bounds stop work, and both only ever skip what can't be
among the k best:

* Cauchy-Schwarz on whole vectors: once |q| |v| is under a query's k-th best score, no shorter candidate counts. A query
  meets only the slices whose longest vector passes, and leaves a slice at the first chunk that doesn't.
* Partial sums: the space is rotated by the right singular vectors of a sample (``sample`` rows, the smallest hashes of vec_id),
  which puts most of the products into the first components. After a quarter and a half of them, the sum so far and the product of
  what is left of both lengths bound the score; only pairs that pass are multiplied in integers.

The rotation decides how much is skipped, never what is found. Vectors all of one length and without structure skip little: all
pairs of a query and a candidate are then multiplied, in blocks of both. The slice of the longest vectors is searched first, and
its k-th best scores are the thresholds that all other slices begin with.

Memory: a task holds a slice and a block of queries of BLOCK_VALUES numbers each, and a few thousand pairs. Vectors that are equal,
or as long as each other, are dealt out by row, so a vector that a third of the rows hold is many slices.

Defined cases: vectors that are null or empty, hold null or non-finite components, or whose number of components isn't the
commonest one take no part; neither do those of 2^31 or longer after scaling (about 2,000,000 before), whose products might not fit;
a zero vector does. Rows without a vec_id take no part. Rows of the query's own vec_id are no candidates of it; other rows
that repeat a vec_id each are one, and each query row is answered. Ties go to the smaller vec_id. Fewer than k candidates are all
returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, written

#: Numbers of a slice of candidates, and of a block of queries: 16,384 vectors of 64 components.
BLOCK_VALUES = 1 << 20
#: Pairs looked at together: queries times candidates.
QUERIES, CHUNK = 512, 512
#: Rotated products are off by less than this share of both lengths.
SLACK = 1e-9
FOUND = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def rotation(sample: np.ndarray) -> np.ndarray:
    """The right singular vectors of the sample's rows, the largest singular value first."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, np.argsort(-values, kind="stable")]


def best_of(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, ties to smaller ids; by row, then rank."""
    order = np.lexsort((ids, -scores, rows))
    ranked = rows[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    rank = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    return order[rank < k]


def search(q: np.ndarray, own: np.ndarray, least: np.ndarray, v: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of q, id, score) of the k best candidates v of each query q with a score of ``least`` or more, and how many products were taken in full.

    q and v are integers; a candidate whose id is ``own`` of the query doesn't count."""
    d = q.shape[1]
    stops = [s for s in dict.fromkeys((d // 4, d // 2)) if 0 < s < d]
    long = lambda x: np.sqrt((x * x).sum(axis=1))
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    length = long(vf)
    order = np.argsort(-length, kind="stable")
    v, vf, ids, length = v[order], vf[order], ids[order], length[order]
    q_length = long(qf)
    qr, vr = qf @ turn, vf @ turn
    rest_q, rest_v = ([long(x[:, s:]) for s in stops] for x in (qr, vr))
    out, taken = [], 0
    for a in range(0, len(q), QUERIES):
        rows = np.arange(a, min(a + QUERIES, len(q)))
        floor = least[rows].astype(np.float64)
        best = [np.zeros(0, np.int64)] * 3  # row, score, id
        for b in range(0, len(v), CHUNK):
            at = slice(b, b + CHUNK)
            live = np.flatnonzero(q_length[rows] * length[b] * (1 + SLACK) >= floor)
            if not len(live):
                break
            some = rows[live]
            slack = SLACK * q_length[some][:, None] * length[at][None] + 1e-6
            wanted = floor[live][:, None] - slack
            i, j = None, None  # all pairs, or those left
            part, done = None, 0
            for n, s in enumerate(stops):
                if i is None:
                    more = qr[some, done:s] @ vr[at, done:s].T
                    part = more if part is None else part + more
                    passing = part + rest_q[n][some][:, None] * rest_v[n][at][None] >= wanted
                    # few pairs go on one by one, many as a block
                    if passing.sum() * 8 < passing.size:
                        i, j = np.nonzero(passing)
                        part = part[i, j]
                else:
                    part = part + np.einsum("ij,ij->i", qr[some[i], done:s], vr[b + j, done:s])
                    passing = part + rest_q[n][some[i]] * rest_v[n][b + j] >= wanted[i, j]
                    i, j, part = i[passing], j[passing], part[passing]
                done = s
            if i is None and q_length[some].max() * length[b] < 1 << 53:
                # every sum on the way is an integer that a double holds
                score = qf[some] @ vf[at].T
                taken += score.size
                enough = np.partition(score, -k - 1, axis=1)[:, -k - 1] if score.shape[1] > k else np.full(len(some), -np.inf)
                i, j = np.nonzero(score >= np.maximum(enough, floor[live])[:, None])
                score = score[i, j].astype(np.int64)
            else:
                if i is None:
                    i, j = (x.ravel() for x in np.indices((len(some), len(length[at]))))
                taken += len(i)
                score = np.concatenate([np.zeros(0, np.int64), *((q[some[i[c : c + 4096]]] * v[b + j[c : c + 4096]]).sum(axis=1) for c in range(0, len(i), 4096))])
            keep = (score >= floor[live][i]) & (ids[b + j] != own[some[i]])
            new = live[i[keep]], score[keep], ids[b + j[keep]]
            if not len(new[0]):
                continue
            best = [np.concatenate(x) for x in zip(best, new, strict=True)]
            top = best_of(*best, k)
            best = [x[top] for x in best]
            full = np.flatnonzero(np.bincount(best[0], minlength=len(rows)) == k)
            last = np.cumsum(np.bincount(best[0], minlength=len(rows)))[full] - 1
            floor[full] = np.maximum(floor[full], best[1][last])
        out.append((rows[best[0]], best[2], best[1]))
    found = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return found[0], found[1], found[2], taken


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _tile(turn, size: int, k: int):  # noqa: ANN001, ANN202
    """The k best of a block of queries in one slice."""

    def run(asked: pa.Table, slices: pa.Table) -> pa.Table:
        if not asked.num_rows or not slices.num_rows:
            return FOUND.empty_table()
        least = asked.column("least").to_numpy()
        row, ids, score, _ = search(_matrix(asked.column("v"), size), asked.column("query_id").to_numpy(), least, _matrix(slices.column("v"), size), slices.column("vec_id").to_numpy(), turn.value, k)
        return pa.table([asked.column("q").to_numpy()[row], ids, score], schema=FOUND)

    return run


def _searched(asked: DataFrame, slices: DataFrame, run) -> DataFrame:  # noqa: ANN001
    """What the slices ``first`` to ``last`` of each query hold: (q, vec_id, score)."""
    every = lambda df: df.where("first <= last").withColumn("slice", F.explode(F.sequence("first", "last"))).drop("first", "last")
    needs = every(asked.groupBy(F.col("block").alias("part")).agg(F.min("first").alias("first"), F.max("last").alias("last")))
    given = slices.join(needs, "slice").select("part", F.col("slice").alias("place"), "vec_id", "v")
    return every(asked).groupBy("block", "slice").cogroup(given.groupBy("part", "place")).applyInArrow(run, "q long, vec_id long, score long")


def largest_products(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, sample: int = 20_000, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of each query row (vec_id, embedding) with the rows of ``vectors``."""
    spark = vectors.sparkSession
    clean = lambda df: (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
        .where("vec_id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
        .select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
        .withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))
        .where(F.col("length") < float(1 << 31))
    )
    sizes = clean(vectors).groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = sizes["s"]
    usable = lambda df: clean(df).where(F.size("v") == size)
    block_rows = max(64, block_values // size)
    # a number of its own for each row keeps equal rows apart; it is written, so that it stays when tasks are run again
    rows = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "mips-rows")
    several = max(1, -(-rows.count() // block_rows))
    dealt = rows.repartitionByRange(several, F.desc("length"), "row").withColumn("slice", F.spark_partition_id())
    slices = written(dealt.select("slice", "vec_id", "v", "length"), "mips-slices")
    # one row for each slice, so a 16,384th of the rows or less
    longest = slices.groupBy("slice").agg(F.max("length").alias("most")).orderBy("slice").toPandas()
    few = hash_sample(slices.select("vec_id", "v"), sample, "vec_id", "v")
    turn = spark.sparkContext.broadcast(rotation(_matrix(few.select("v").toArrow().column("v"), size).astype(np.float64)))

    asked = written(usable(queries).withColumn("q", F.monotonically_increasing_id()).withColumnRenamed("vec_id", "query_id"), "mips-queries")
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    run = _tile(turn, size, k)
    top = int(longest["slice"].min())
    first = asked.withColumns({"least": F.lit(float("-inf")), "first": F.lit(top), "last": F.lit(top)})
    found = written(_searched(first, slices, run), "mips-first")
    least = found.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    numbers, falling = longest["slice"].to_numpy(np.int64), -np.maximum.accumulate(longest["most"].to_numpy()[::-1])[::-1]

    @F.pandas_udf("int")
    def last_slice(length: pd.Series, least: pd.Series) -> pd.Series:
        """The last slice whose longest vector may reach ``least``."""
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where((least > 0) & (length > 0), least / (length * (1 + SLACK)), 0.0)
        place = np.searchsorted(falling, -reach, "right")
        return pd.Series(np.where(place > 0, numbers[np.maximum(place, 1) - 1], -1))

    rest = asked.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    rest = rest.withColumns({"first": F.lit(top + 1), "last": last_slice("length", "least")})
    both = found.unionByName(_searched(rest, slices, run))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "query_id"), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
