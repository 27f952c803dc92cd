"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own codebook (k-means in numpy on at most ``sample`` vectors, the
smallest hashes of vec_id); a cell is a pair of centroids. Every vector is indexed. A query takes cells in the order of
their summed distances, with a heap over the two sorted lists of centroids, until the cells hold as many distinct vectors
as are wanted, and the entries of those cells are reranked by their exact cosine, in double precision.

How many are wanted is measured, unless ``share`` of all is given: the true neighbours of ``probes`` vectors are found among
all entries, and as many are taken as leave a share ``recall`` of these in the cells read. Vectors in
clusters need few; vectors without structure need a third of all or more.

Equal vectors are one entry with its k + 1 smallest ids: no more can be among a query's k nearest, so a vector that a third
of the rows hold costs as much as any other. Cells are dealt out in slices of their entries, so a hot cell is many tasks,
and each task hands on only its k nearest of each query.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; neither do those whose
length isn't the commonest one; a null vec_id is no candidate and no query; rows that repeat a vec_id are rows of their own,
none of which is a candidate of that id; other columns are ignored; fewer than k candidates are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, written

#: Entries of a slice of a cell range (a 256th of all, within bounds), and queries of a block, that one task multiplies.
SLICE_LEAST, SLICE_MOST, QUERY_BLOCK = 1024, 1 << 16, 1 << 15


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)


def traverse(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * columns + j) by ascending left[i] + right[j] until they hold ``wanted`` entries; counts (rows, columns)."""
    rows, columns = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, out, held = [(left[rows[0]] + right[columns[0]], 0, 0)], [], 0
    # the pair (a, b) is followed by (a + 1, b), and from a = 0 by (0, b + 1): each pair comes once
    while heap and held < wanted:
        _, a, b = heapq.heappop(heap)
        n = int(counts[rows[a], columns[b]])
        if n:
            out.append(int(rows[a]) * counts.shape[1] + int(columns[b]))
            held += n
        if a + 1 < len(rows):
            heapq.heappush(heap, (left[rows[a + 1]] + right[columns[b]], a + 1, b))
        if a == 0 and b + 1 < len(columns):
            heapq.heappush(heap, (left[rows[0]] + right[columns[b + 1]], 0, b + 1))
    return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _valid(size: int, most: int):  # noqa: ANN202
    """Distinct vectors of a batch with the smallest ids of each."""
    shape = pa.schema([("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("v"), size), batch.column("vec_id").to_numpy(zero_copy_only=False)
            x = x + 0.0  # no negative zeros
            u, inverse = np.unique(x, axis=0, return_inverse=True)
            order = np.lexsort((ids, inverse.ravel()))
            groups = np.split(ids[order], np.flatnonzero(np.diff(inverse.ravel()[order])) + 1) if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array(list(u), shape.field("v").type), pa.array([np.unique(g)[:most] for g in groups], shape.field("ids").type)], schema=shape)

    return run


def _assign(books: tuple[np.ndarray, np.ndarray], size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            h = size // 2
            cell = distances(x[:, :h], books[0]).argmin(axis=1) * len(books[1]) + distances(x[:, h:], books[1]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *batch.columns], names=["cell", *batch.schema.names])

    return run


def _route(books: tuple[np.ndarray, np.ndarray], counts, wanted: int, size: int, groups):  # noqa: ANN001, ANN202
    """Queries with the cells to read in each group of cells."""
    shape = pa.schema([("grp", pa.int64()), ("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = counts.value, groups.value
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            h = size // 2
            left, right = distances(unit[:, :h], books[0]), distances(unit[:, h:], books[1])
            out = []
            for i, q in enumerate(batch.column("vec_id").to_pylist()):
                cells = np.array(traverse(left[i], right[i], table, wanted), np.int64)
                for g in np.unique(of[cells]) if len(cells) else []:
                    out.append((int(g), q, x[i], cells[of[cells] == g]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return run


def _rerank(k: int):  # noqa: ANN202
    """The k nearest of each query among a slice of the entries of a group of cells."""

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(entries):
            return none
        x, cell = np.stack(entries["v"].to_numpy()), entries["cell"].to_numpy()
        nx, ids = np.sqrt((x**2).sum(axis=1)), entries["ids"].to_numpy()
        out = []
        for q, v, cells in zip(queries["query_id"], queries["v"], queries["cells"], strict=True):
            at = np.flatnonzero(np.isin(cell, cells))
            if not len(at):
                continue
            score = (x[at] * v).sum(axis=1) / (nx[at] * np.sqrt((v**2).sum()))
            # every entry has at least one id, and one of them may be the query's own
            if len(at) > k + 1:
                cut = np.partition(score, len(at) - k - 1)[len(at) - k - 1]
                at, score = at[score >= cut], score[score >= cut]
            own = sorted((-s, int(i)) for s, a in zip(score, at, strict=True) for i in ids[a] if i != q)[:k]
            out += [(q, i, -s) for s, i in own]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(none.dtypes.to_dict()) if out else none

    return run


def _probe(ids: np.ndarray, x: np.ndarray, k: int, size: int):  # noqa: ANN202
    """The k nearest entries of each probe among a task's entries."""
    shape = pa.schema([("probe", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64()), ("cell", pa.int64())])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0), np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), size)
            own = batch.column("ids").combine_chunks() if isinstance(batch.column("ids"), pa.ChunkedArray) else batch.column("ids")
            first = own.flatten().to_numpy()[np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())[:-1]])]
            score = np.where(first[None] == ids[:, None], -9.0, unit @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T)
            wide = lambda y: np.broadcast_to(y, score.shape)  # noqa: B023, E731
            both = [np.concatenate([a, b], axis=1) for a, b in zip(best, (score, wide(first), wide(batch.column("cell").to_numpy())), strict=True)]
            top = np.argsort(-both[0], axis=1, kind="stable")[:, :k]
            best = [np.take_along_axis(y, top, 1) for y in both]
        n = best[0].shape[1]
        if n:
            keep = best[0].ravel() > -8
            yield pa.RecordBatch.from_arrays([pa.array(y.ravel()[keep]) for y in (np.repeat(np.arange(len(ids)), n), *best)], schema=shape)

    return run


def entries_wanted(index: DataFrame, probes: DataFrame, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int, recall: float) -> int:
    """How many entries the cells read must hold at least, so that ``recall`` of the probes' true neighbours (v, i) are among them."""
    few = probes.toPandas()
    x, ids = np.stack(few["v"].to_numpy()), few["i"].to_numpy(np.int64)
    size = x.shape[1]
    near = index.mapInArrow(_probe(ids, x, k, size), "probe long, score double, vec_id long, cell long")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("probe", "cell").toPandas()
    unit, h = x / np.linalg.norm(x, axis=1, keepdims=True), size // 2
    before = []
    for p, cells in near.groupby("probe")["cell"]:
        order = np.argsort((distances(unit[p : p + 1, :h], books[0])[0][:, None] + distances(unit[p : p + 1, h:], books[1])[0][None]).ravel(), kind="stable")
        held = np.empty(len(order), np.int64)
        held[order] = np.cumsum(counts[order]) - counts[order]
        before += held[cells.to_numpy()].tolist()
    return int(np.quantile(before, recall, method="higher")) + 1 if before else 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float | None = None, recall: float = 0.96, least: int = 1, sample: int = 20_000, probes: int = 256, books: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query row (vec_id, embedding), nearest first."""
    spark = vectors.sparkSession
    sc = spark.sparkContext
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    out_shape = "query_id long, rank int, vec_id long, score double"
    sizes = clean(vectors).groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    if sizes is None:
        return spark.createDataFrame([], out_shape)
    size = sizes["s"]
    usable = lambda df: clean(df).where(F.size("v") == size)
    distinct = usable(vectors).mapInArrow(_valid(size, k + 1), "v array<double>, ids array<long>")
    distinct = written(distinct.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")), "ann-distinct")
    n = distinct.count()
    named = distinct.select("v", F.element_at("ids", 1).alias("i"))
    x = np.stack(hash_sample(named, sample, "i").toPandas()["v"].to_numpy())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = size // 2
    centroids = books or int(np.clip(2 ** round(np.log2(max(n, 1)) / 2 - 1), 4, 256))
    pair = kmeans(x[:, :h], centroids, seed=1), kmeans(x[:, h:], centroids, seed=2)
    index = written(distinct.mapInArrow(_assign(pair, size), "cell long, v array<double>, ids array<long>"), "ann-index")
    cells = index.groupBy("cell").count().toPandas()  # centroids ** 2 rows at most
    counts = np.zeros(len(pair[0]) * len(pair[1]), np.int64)
    counts[cells["cell"].to_numpy(np.int64)] = cells["count"].to_numpy(np.int64)
    # neighbouring cells make a group of about a slice of entries; a fuller cell is a group of several slices
    slice_rows = int(np.clip(n // 256, SLICE_LEAST, SLICE_MOST))
    group = (np.cumsum(counts) - counts) // slice_rows
    slices = np.maximum(1, -(-np.bincount(group, counts).astype(np.int64) // slice_rows))
    wanted = max(least, k + 1, int(np.ceil(share * n)) if share is not None else entries_wanted(index, hash_sample(named, probes, "i"), pair, counts, k, recall))
    routed = usable(queries).mapInArrow(_route(pair, sc.broadcast(counts.reshape(len(pair[0]), -1)), wanted, size, sc.broadcast(group)), "grp long, query_id long, v array<double>, cells array<long>")
    groups = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(group)), "grp": group, "slices": slices[group]}).astype("int64"))
    entries = index.join(F.broadcast(groups), "cell").withColumn("slice", F.pmod(F.xxhash64("ids"), F.col("slices"))).drop("slices")
    asked = routed.join(F.broadcast(groups.select("grp", "slices").distinct()), "grp").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    # queries by the million are cut into blocks, each of which meets every slice
    blocks = max(1, -(-usable(queries).count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    entries = entries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = asked.groupBy("grp", "slice", "block").cogroup(entries.groupBy("grp", "slice", "block")).applyInPandas(_rerank(k), "query_id long, vec_id long, score double")
    best = found.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


