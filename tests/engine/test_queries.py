import duckdb
import pytest

from tallyline.plans import suite

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query_matches_sql(spark, data, duck, name):
    df = suite.queries()[name](spark, data)
    rows = sorted((tuple(str(plain(r[c])) for c in sorted(df.columns)) for r in df.collect()))
    if name not in suite.oracle_sql():
        assert rows
        return
    got = duck.sql(suite.oracle_sql()[name])
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    assert sorted(df.columns) == [got.columns[i] for i in order]
    assert rows == sorted(tuple(str(plain(r[i])) for i in order) for r in got.fetchall())


def test_queries_read_whole_texts(spark, tmp_path):
    """What stands behind the first words or characters counts too."""
    words = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(1, words + " over and done" * 200), (2, words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same = "abcdefghij" * 30
    turns = [(1, 0, "user", same + "k"), (1, 1, "assistant", same + "q"), (2, 0, "user", "I have twenty six of them. Is that right")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: suite.queries()[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.repetitive for r in run("win14_repetition")} == {1: True, 2: False}
    assert [("substitution", "k", "q", 1)] == [(r.op, r.ref, r.hyp, r.n) for r in run("agg11_commonest_edits") if r.op == "substitution"]
    assert "right" in next(r.text for r in run("sc21_basic_cleanup") if r.i == 2000)
    assert {r.span for r in run("sc33_inserted_span")} == {"XYZ"}


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    """Conversations whose pairs of turns make tables of up to 12,000,000 cells."""
    import random

    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    base = some(3500)
    turns = [(1, 0, "user", base), (1, 1, "assistant", base[:1000] + "qqq" + base[1000:]), (1, 2, "user", some(2600)), (1, 3, "assistant", some(2900)), (1, 4, "user", "short"), (1, 5, "assistant", "shirt"), (2, 0, "user", some(3000))]
    path = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def same_as_sql(spark, path, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    got, df = con.sql(suite.oracle_sql()[name]), suite.queries()[name](spark, path)
    return sorted(str([plain(r[c]) for c in got.columns]) for r in df.collect()) == sorted(str([plain(x) for x in r]) for r in got.fetchall())


def test_long_turns_are_aligned(spark, long_turns):
    assert same_as_sql(spark, long_turns, "sc03_alignments")


def test_edits_of_long_turns_are_summed(spark, long_turns):
    assert same_as_sql(spark, long_turns, "agg09_edit_metrics")


def test_edits_of_long_turns_are_counted(spark, long_turns):
    """As many as agg09's errors in all, and the query has the first 30 of each kind of these."""
    from tallyline.functions import edit
    from tallyline.operators import candidates
    from tallyline.plans.suite_scoring import rated

    errors = sum(r.errors for r in suite.queries()["agg09_edit_metrics"](spark, long_turns).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{long_turns}/conversations.parquet/*.parquet')")
    assert errors == con.sql(f"SELECT sum(errors) FROM ({suite.oracle_sql()['sc03_alignments']})").fetchall()[0][0]
    rows = rated(spark, long_turns).withColumn("alignment", edit.alignment("ref_key", "hyp_key"))
    every = candidates.error_counts(rows, "sample_id").collect()
    assert sum(r.n for r in every) == errors and {r.n for r in every if (r.op, r.hyp) == ("insertion", "q")} == {3}
    got = {(r.op, r.place): (r.ref, r.hyp, r.n) for r in suite.queries()["agg11_commonest_edits"](spark, long_turns).collect()}
    for op in ("substitution", "deletion", "insertion"):
        own = sorted((r for r in every if r.op == op), key=lambda r: (-r.n, r.first))
        assert [got.pop((op, i)) for i in range(1, min(len(own), 30) + 1)] == [(r.ref, r.hyp, r.n) for r in own[:30]]
    assert not got


def test_lists_have_all_candidates(spark, tmp_path):
    """A conversation of 1,300 turns: candidates past the 1,000th count, and its pairs, over several blocks, are those of brute force."""
    from pyspark.sql import functions as F

    from tallyline.operators import candidates

    word = lambda i: "".join(chr(97 + (i * 7919 + 13 * j * (i % 11 + 1)) % 26) for j in range(1 + i % 9))
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", "reference" if i == 1200 else word(i)) for i in range(1300)]
    turns[0] = (1, 0, "user", "reference")
    turns += [(2, 0, "user", "one"), (2, 1, "assistant", "two"), (3, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: suite.queries()[name](spark, str(tmp_path)).collect()
    assert len(run("jn15_candidates_by_reference")) == 1300
    assert {r.sample_id: r["rank"] for r in run("win03_earliest_best_rank")} == {1: 1200, 2: 1}

    rows = [(7, i, word(i % 800)) for i in range(900)] + [(8, 1, "a"), (8, 2, "b"), (9, 1, "a"), (9, 2, "a")]
    df = spark.createDataFrame(rows, "sample_id long, rank long, key string").withColumn("text", F.col("key"))

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    texts = {}
    for _, i, k in rows[:900]:
        texts.setdefault(k, i)
    names = sorted(texts, key=texts.get)
    assert len(names) > candidates.PAIR_ROWS
    d = {(a, b): apart(a, b) for n, a in enumerate(names) for b in names[n + 1 :]}
    got = {r.sample_id: (r.pairs, r.mean_distance) for r in candidates.diversity(df, F.col("key")).collect()}
    assert got[7] == (len(d), pytest.approx(sum(v / max(len(a), len(b)) for (a, b), v in d.items()) / len(d))) and got[8] == (1, 1.0) and 9 not in got
    mean = dict.fromkeys(names, 0)
    for (a, b), v in d.items():
        mean[a] += v
        mean[b] += v
    best = {texts[k] for k, v in mean.items() if v == min(mean.values())}
    assert {r["rank"] for r in candidates.medoids(df, F.col("key")).collect() if r.sample_id == 7} == best


def test_rescored_ties_are_those_of_sql(spark, tmp_path):
    """A tenth of a length is k / 10 as decimals have it, not k * 0.1: scores that are equal there stay equal, and go by rank."""
    rows = [(1, 0, "user", "reference")] + [(1, t, "assistant", "".join(chr(97 + i % 26) for i in range(n)) + " " * b) for t, (n, b) in enumerate(((n, b) for n in (3, 6, 7, 8, 11, 12, 13, 14) for b in range(24)), 1)]
    rows = [r for r in rows] + [(c, t, role, text) for c in range(2, 60) for _, t, role, text in rows if t == 0 or (t * 7 + c) % 5 == 0]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = {(r.sample_id, r["rank"]) for r in suite.queries()["srt04_rescored_first"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(suite.oracle_sql()["srt04_rescored_first"]).fetchall())


def test_percentiles_count_equal_values_before_they_meet(spark, tmp_path):
    """Repeated, null and single prices, against SQL; the values that meet in a flag's task are counted before."""
    rows = [("A", float(i % 7)) for i in range(500)] + [("B", None), ("B", 2.5), ("C", None), (None, 1.0), (None, 4.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_extendedprice double").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    df = suite.queries()["agg03_percentiles"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.sql(suite.oracle_sql()["agg03_percentiles"]).fetchall()))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
