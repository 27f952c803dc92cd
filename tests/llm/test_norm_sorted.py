import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import norm_sorted, queries

SHAPE = "vec_id long, embedding array<double>, q long, v int, length string, slice int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "c", 3, 0.5) for i, x in rows], SHAPE)


def naive(rows, asked, k):
    ints = lambda x: [math.floor(1024 * c) for c in x]
    good = lambda x: x is not None and len(x) == 3 and all(c is not None and math.isfinite(c) for c in x)
    out = []
    for i, x in asked:
        if i is None or not good(x):
            continue
        every = sorted((-sum(a * b for a, b in zip(ints(x), ints(y), strict=True)), j) for j, y in rows if j is not None and j != i and good(y))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(every[:k])]
    return sorted(out)


@pytest.mark.parametrize("values", [1 << 20, 192])
def test_whole_search_by_brute_force(spark, values):
    """Ties, repeated rows and ids, zero vectors and those that take no part; as one slice, and as slices of 64 rows with 64 queries a block."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(size=3) * 10 ** rng.uniform(-2, 1)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, -0.125]) for i in range(200)]  # one vector in a third of the rows
    rows += [(7, rows[7][1]), (7, [1.0, 2.0, 3.0]), (9, rows[9][1]), (2000, [0.0, 0.0, 0.0]), (2001, [-0.0, 0.0, 1e-9])]
    rows += [(None, [1.0, 1.0, 1.0]), (2002, None), (2003, [1.0, None, 2.0]), (2004, [1.0, float("nan"), 2.0]), (2005, [float("inf"), 0.0, 0.0]), (2006, [1.0, 2.0]), (2007, [])]
    df = table(spark, rows)
    asked = [r for r in rows if r[0] is None or r[0] % 5 == 0 or r[0] in (7, 2001)]
    got = norm_sorted.largest_products(df, table(spark, asked), k=10, sample=100, block_values=values)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == naive(rows, asked, 10)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (100, [-1.0, 0.0, 2.0])]
    df = table(spark, rows)
    assert sorted(tuple(r) for r in norm_sorted.largest_products(df, df.where("vec_id % 100 = 0")).collect()) == naive(rows, [rows[0], rows[2]], 10)
    assert norm_sorted.largest_products(df.where("false"), df).collect() == []
    assert norm_sorted.largest_products(df, df.where("false")).collect() == []
    assert norm_sorted.largest_products(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []


def test_bounds_skip_products_and_lose_none():
    """Lengths that fall off and few strong directions: under a tenth of the products are taken, the answer stays that of all."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 32))
    make = lambda n: (1024 * (rng.normal(size=(n, 8)) * (0.5 ** np.arange(8))) @ base * rng.pareto(2, size=(n, 1))).astype(np.int64)
    v, q = make(20_000), make(100)
    ids = rng.permutation(len(v)).astype(np.int64)
    turn = norm_sorted.rotation(v[:500].astype(np.float64))
    row, found, score, taken = norm_sorted.search(q, np.full(len(q), -1), np.full(len(q), -np.inf), v, ids, turn, 10)
    every = q @ v.T
    for i in range(len(q)):
        want = sorted(zip(-every[i], ids, strict=True))[:10]
        assert [(-s, j) for s, j in zip(score[row == i], found[row == i], strict=True)] == want
    assert taken < 0.1 * every.size


def test_products_beyond_doubles_are_exact():
    rng = np.random.default_rng(2)
    v, q = (rng.integers(-(1 << 28), 1 << 28, size=(n, 4)) for n in (700, 3))
    row, found, score, _ = norm_sorted.search(q, np.full(3, 5), np.full(3, -np.inf), v, np.arange(700), np.eye(4), 2)
    for i in range(3):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], x, strict=True)), j) for j, x in enumerate(v) if j != 5)[:2]
        assert [(-int(s), int(j)) for s, j in zip(score[row == i], found[row == i], strict=True)] == want


def test_thresholds_keep_ties():
    """A threshold of just the k-th score, reached by equal vectors of smaller ids."""
    v = np.array([[3, 0], [0, 3], [3, 0], [3, 0]])
    row, ids, score, _ = norm_sorted.search(np.array([[2, 0]]), np.array([9]), np.array([6.0]), v, np.array([4, 1, 2, 3]), np.eye(2), 2)
    assert (row.tolist(), ids.tolist(), score.tolist()) == ([0, 0], [2, 3], [6, 6])


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(250)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    read = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).collect()]
    got = queries.queries()["op13_norm_sorted"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == naive(read, [r for r in read if r[0] % 100 == 0], 10)
