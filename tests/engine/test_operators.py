import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions import text
from tallyline.operators import auditing, candidates, comparison, pixels, reranking, sampling, scoring, selection, timeseries, validation


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_missing_and_failed_rows_stay_in_the_denominator(spark):
    s = spark.createDataFrame([(i, "abcd", "s", float(i)) for i in range(4)], "sample_id long, reference string, speaker string, duration_seconds double")
    p = spark.createDataFrame([(0, "abcd", "auto", None, 1.0, 1), (0, "zzzz", "auto", None, 1.0, 0), (1, "abxd", "review", None, 2.0, 1), (2, "abcd", "auto", "boom", 3.0, 1), (9, "x", "auto", None, 1.0, 1)], "sample_id long, raw string, action string, error string, processing_seconds double, ord long")
    got = scoring.scored(scoring.paired_predictions(s, p), text.ascii_key)
    assert rows(got, "sample_id", "errors", "exact", "error") == [(0, 0, True, None), (1, 1, False, None), (2, 4, False, "boom"), (3, 4, False, "Missing prediction")]
    m = scoring.pooled(got).first()
    assert (m.errors, m.characters, m.cer, m.coverage, m.failures) == (9, 16, 9 / 16, 0.5, 2) and m.automatic_cer == 0
    assert m.p95 == pytest.approx(np.percentile([1, 2, 3], 95))
    assert rows(scoring.unexpected_predictions(s, p), "sample_id") == [(9,)]
    empty = scoring.pooled(got.where("false")).first()
    assert (empty.samples, empty.cer, empty.coverage) == (0, None, None)
    assert scoring.word_metrics(spark.createDataFrame([], "edits long, words long")).first().wer == 0.0
    gate = {r.criterion: r.passed for r in scoring.gates(scoring.pooled(got).crossJoin(spark.createDataFrame([(1, 1)], "speakers long, min_sessions long")), scoring.Thresholds(samples=4, cer=0.6)).collect()}
    assert gate["samples"] and gate["cer"] and not gate["coverage"]
    with pytest.raises(ValueError):
        scoring.Thresholds(cer=2)


def test_nearest_rank_rounds_half_to_even(spark):
    for n in range(1, 13):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "v double")
        assert scoring.nearest_rank("v", 0.5)(df).first().value == min(n - 1, round(0.5 * (n - 1)))


def test_pairing_and_bootstrap(spark):
    a = spark.createDataFrame([(i, "s" + str(i % 2), 10, 3, False) for i in range(6)], "sample_id long, speaker string, characters long, errors long, exact boolean")
    b = a.withColumn("errors", F.when(F.col("speaker") == "s0", 1).otherwise(4)).where("sample_id < 5").unionByName(a.limit(1).withColumn("sample_id", F.lit(77).cast("long")))
    assert rows(comparison.unpaired(a, b), "sample_id", "side") == [(5, "missing"), (77, "unexpected")]
    pairs = comparison.paired(a, b, ["speaker"])
    d = {r.speaker: r.delta_pp for r in comparison.deltas(pairs, "speaker").collect()}
    assert d["s0"] == pytest.approx(-20) and d["s1"] == pytest.approx(10)
    one = comparison.cluster_bootstrap(pairs, draws=400).first()
    again = comparison.cluster_bootstrap(pairs.repartition(3), draws=400).first()
    assert one == again and one.low == pytest.approx(-20) and one.high == pytest.approx(10)
    assert comparison.cluster_bootstrap(pairs.where("speaker = 's0'")).first().low is None
    declared = comparison.cohorts(pairs, {"speaker": ["s0", "s9"]})
    assert {(r.value, r.samples) for r in declared.collect()} == {("s0", 3), ("s1", 2), ("s9", 0)}
    wrong = comparison.mismatches(spark.createDataFrame([(1, "a", None), (2, None, "x")], "sample_id long, r string, d string"), spark.createDataFrame([(1, "a", None), (2, None, None)], "sample_id long, r string, d string"), ["r"], ["d"])
    assert rows(wrong, "sample_id", "field") == [(2, "d"), (2, "r")]


def test_interval_overlaps_are_half_open(spark):
    rng = np.random.default_rng(0)
    made = [(i, "ab"[int(rng.integers(2))], float(rng.integers(0, 400)), None) for i in range(60)]
    made = [(i, k, s, None if rng.random() < 0.1 else s + float(rng.integers(0, 150))) for i, k, s, _ in made] + [(100, "c", 0.0, 5.0), (101, "c", 5.0, 9.0), (102, "", 0.0, 9.0), (103, "", 0.0, 9.0), (104, None, 0.0, 1.0)]
    df = spark.createDataFrame(made, "i long, k string, s double, e double")
    want = set()
    for i, k, s, e in made:
        for j, k2, s2, e2 in made:
            if i < j and k and k == k2 and max(s, s2) < min(math.inf if e is None else e, math.inf if e2 is None else e2):
                want.add((i, j))
    got = auditing.overlapping(df, "k", "s", "e", "i").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_audits(spark):
    df = spark.createDataFrame([("train", "a", "h1"), ("dev", "a", "h2"), ("test", "b", "h1"), ("test", "", None)], "split string, speaker string, sha256 string")
    got = auditing.split_overlaps(df, {"speaker": F.col("speaker"), "hash": F.col("sha256")}, [("train", "dev"), ("train", "test")])
    assert rows(got, "key", "first", "second", "value") == [("hash", "train", "test", "h1"), ("speaker", "train", "dev", "a")]
    t = spark.createDataFrame([(1, "x"), (2, "y")], "sample_id long, k string")
    assert rows(auditing.exposure(t, t.where("k = 'x'"), t.where("false"), "k"), "sample_id", "exposure") == [(1, "seen"), (2, "unseen")]
    assert rows(auditing.exposure(t, t.where("k = 'x'"), None, "k"), "sample_id", "exposure") == [(1, "seen"), (2, "unknown")]
    assert rows(auditing.contradictions(df, "sha256", "speaker"), "sha256") == [("h1",)]


def test_samples_don_t_depend_on_order(spark):
    df = spark.createDataFrame([(f"g{i % 5}", f"i{i}", i) for i in range(35)], "g string, item string, note long")
    a = sampling.round_robin(df, "g", "item", 3, 12, 1)
    assert a.groupBy("g").count().agg(F.min("count"), F.max("count")).first() == (4, 4)
    b = sampling.round_robin(df.orderBy(F.rand(3)).withColumn("note", F.lit(0).cast("long")), "g", "item", 3, 12, 1)
    assert rows(a, "item", "place") == rows(b, "item", "place")
    assert sampling.held_out(df, "item", 6).where("part = 'test'").count() == 6


def test_selection_needs_no_regression(spark):
    r = [("base", 0, "clean", 10, 5, 1.0, 0), ("base", 0, "stress", 20, 5, 1.0, 0), ("a", 1, "clean", 5, 5, 1.0, 0), ("a", 1, "stress", 21, 5, 1.0, 0), ("b", 2, "clean", 9, 5, 1.0, 0), ("b", 2, "stress", 20, 5, 1.0, 0), ("c", 3, "clean", 9, 5, 1.0, 0), ("c", 3, "stress", 20, 6, 1.0, 0), ("d", 4, "clean", 0, 9, 1.0, 1), ("d", 4, "stress", 0, 9, 1.0, 0)]
    df = spark.createDataFrame(r, "config string, ord int, condition string, errors long, exact long, coverage double, failures int")
    assert selection.gated_choice(df, "base").first().config == "b"
    assert selection.gated_choice(df.where("config in ('base', 'a')"), "base").first().config == "base"
    e = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.4), ("r", 3, 0.4)], "run string, epoch int, cer double")
    assert selection.best_epoch(e, 0.45).first().epoch == 2 and selection.best_epoch(e, 0.1).first().epoch is None


def test_candidate_lists(spark):
    df = spark.createDataFrame([(1, "raw", []), (2, "raw", [("b", 2.0), ("a", 1.0), ("b", 0.5)])], "sample_id long, raw string, hypotheses array<struct<text:string,score:double>>")
    flat = candidates.exploded(df)
    assert rows(flat, "sample_id", "rank", "text") == [(1, 1, "raw"), (2, 1, "b"), (2, 2, "a"), (2, 3, "b")]
    scored = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 2, 10), (1, 3, 2, 10), (2, 1, 1, 10)], "sample_id long, rank long, errors long, characters long")
    assert rows(candidates.oracle_at(scored, [1, 2, 10]), "k", "errors") == [(1, 6), (10, 3), (2, 3)]
    assert rows(candidates.best_rank(scored), "sample_id", "rank") == [(1, 2), (2, 1)]
    assert rows(candidates.distinct_texts(flat, F.col("text"), 2), "sample_id", "key", "place") == [(1, "raw", 1), (2, "a", 2), (2, "b", 1)]


@pytest.mark.parametrize(("tokens", "want"), [("a a a a a a", True), ("a b a b a b", True), ("a b c d e f", False), ("x y z " * 5, True), ("p q r s t u v w x y z a b", False), ("a b c d a b c d a b c d", True), ("a b c a b c a b c a b p q r s t u", False)])
def test_repetition(spark, tokens, want):
    df = spark.createDataFrame([(tokens.split(),)], "t array<string>")
    assert df.select(candidates.repetitive(F.col("t")).alias("r")).first().r is want


def test_repetition_by_brute_force(spark):
    rng = random.Random(4)
    lists = []
    for _ in range(300):
        phrase = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))]
        said = (phrase * 9)[: rng.randrange(0, 40)]
        lists.append([rng.choice("xyz") for _ in range(rng.randrange(6))] + said + [rng.choice("pqrstu") for _ in range(rng.randrange(14))])

    def brute(t):
        copies = lambda w, s: next(i for i in range(1, len(t) + 2) if t[s + i * w : s + (i + 1) * w] != t[s : s + w])
        loops = [(copies(w, s), w) for w in range(3, 13) for s in range(len(t) - 3 * w + 1)]
        return len(t) >= 6 and len(set(t)) <= 2 or len(t) >= 12 and any(c >= 3 and c * w >= 0.6 * len(t) for c, w in loops)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i long, t array<string>")
    got = {r.i: r.r for r in df.select("i", candidates.repetitive(F.col("t")).alias("r")).collect()}
    assert [got[i] for i in range(len(lists))] == [brute(t) for t in lists] and 20 < sum(got.values()) < 280


def test_routing(spark):
    c = F.lit
    none = c(None).cast("string")
    got = spark.range(1).select(
        candidates.routed(none, c("ok"), c(False), c(False), c(0.5), c(True), "auto", 0.2).alias("auto"), candidates.routed(none, c("ok"), c(False), c(True), c(0.5), c(True), "auto", 0.2).alias("han"), candidates.routed(none, c(" "), c(False), c(False), c(0.5), c(True), "auto", 0.2).alias("empty"),
        candidates.routed(none, c("ok"), c(False), c(False), c(None).cast("double"), c(True), "auto", 0.2).alias("margin"), candidates.routed(c("face"), c("ok"), c(False), c(False), c(0.5), c(True), "auto", 0.2).alias("face"), candidates.routed(none, c("ok"), c(False), c(False), c(0.5), c(True), "off", 0.2).alias("off")).first()
    assert tuple(got) == ("auto", "review", "retry", "review", "retry", "review")


def test_reranking(spark):
    corpus = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "a c")], "i long, text string")
    got = {r.k: r.score for r in reranking.bigram_scores(spark.createDataFrame([(0, "a b"), (1, "z")], "k long, text string"), "k", "text", corpus, "text").collect()}
    p = lambda cond, n: 0.6 * cond + 0.4 * (n + 0.1) / (6 + 0.3)
    assert got[0] == pytest.approx((math.log(p(1.0, 3)) + math.log(p(2 / 3, 2))) / 2) and got[1] == pytest.approx(math.log(p(0, 0)))
    q = spark.createDataFrame([(0, "rare words here")], "q long, text string")
    ph = spark.createDataFrame([(i, t) for i, t in enumerate(["rare words", "words here rare", "x", "y", "z", "rare words"])], "i long, text string")
    assert [r.i for r in sorted(reranking.similar(q, ph, least=1.0).collect(), key=lambda r: r.place)][:3] == [1, 5, 0]


def test_resampling(spark):
    def nearest(ts, fps=25.0):
        if any(math.isnan(t) for t in ts) or any(b <= a for a, b in zip(ts, ts[1:])):  # noqa: B905
            return list(range(len(ts)))
        out = []
        for k in range(int(math.floor((ts[-1] - ts[0]) * fps + 1e-6)) + 1):
            g = ts[0] + k / fps
            out.append(min(range(len(ts)), key=lambda i: (abs(ts[i] - g) - (1e-9 if False else 0), i)))
        return out

    clips = {0: [i / 25 for i in range(60)], 1: [i / 30 for i in range(90)], 2: [0, 0.03, 0.081, 0.13, 0.159, 0.201], 3: [0.0, 0.1, 0.1, 0.2], 4: [0.0, float("nan"), 0.2], 5: [3.0]}
    df = spark.createDataFrame([(c, i, float(t)) for c, ts in clips.items() for i, t in enumerate(ts)], "clip_id long, frame_no long, ts double")
    got = {}
    for r in sorted(timeseries.resampled(df).collect(), key=lambda r: (r.clip_id, r.k)):
        got.setdefault(r.clip_id, []).append(r.frame_no)
    for c in (2, 3, 4, 5):
        assert got[c] == nearest(clips[c])
    for c in (0, 1):
        assert len(got[c]) == len(nearest(clips[c])) and max(abs(clips[c][a] - clips[c][b]) for a, b in zip(got[c], nearest(clips[c]), strict=True)) <= 1 / 25


def test_gaps_and_smoothing(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [(1, i, None) for i in range(3)], "clip_id long, frame_no long, v double")
    assert rows(timeseries.filled(df, "v"), "clip_id", "frame_no", "filled") == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, 3.0), (0, 4, 4.0), (0, 5, 4.0), (1, 0, None), (1, 1, None), (1, 2, None)]
    x = np.random.default_rng(1).random(30)
    got = timeseries.smoothed(spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "clip_id long, frame_no long, v double"), "v").collect()
    for r in got:
        m = min(6, r.frame_no, 29 - r.frame_no)
        assert r.smooth == pytest.approx(x[r.frame_no - m : r.frame_no + m + 1].mean())
    steps = spark.createDataFrame([(0, i, t) for i, t in enumerate([0, 5, 5, 0, 5, 7, 7])], "clip_id long, frame_no long, t int")
    assert [r.t for r in sorted(timeseries.collapsed(steps, "t").collect(), key=lambda r: r.frame_no)] == [5, 5, 7]


def test_chunks_need_over_half_the_frames(spark):
    chunks = spark.createDataFrame([(0, 1, 0.0, 0.5, 1.0), (0, 2, 0.4, 0.3, 2.0), (1, 1, 0.0, 0.5, 9.0)], "clip_id long, chunk long, t0 double, seconds double, value double")
    targets = spark.createDataFrame([(0, 0.0, 10), (1, 0.0, 10)], "clip_id long, start double, n int")
    got = {}
    for r in sorted(timeseries.placed_chunks(chunks, targets, 0.1).collect(), key=lambda r: (r.clip_id, r.k)):
        got.setdefault(r.clip_id, []).append(r.value)
    assert got[0] == [1.0] * 4 + [2.0] * 3 + [None] * 3 and got[1] == [None] * 10


def test_pixels(spark):
    rng = np.random.default_rng(2)
    stack = rng.integers(0, 256, (5, 64))
    stack[3] = 0
    df = spark.createDataFrame([(0, i, f.tolist()) for i, f in enumerate(stack)], "clip_id long, frame_no long, pixels array<int>")
    cfg = pixels.Stabilisation()
    q = np.percentile(stack, [10, 50, 90], axis=1)
    b, c, sat = q[1], q[2] - q[0], np.mean((stack == 0) | (stack == 255), axis=1)
    ok = (b >= cfg.min_brightness) & (b <= cfg.max_brightness) & (c >= cfg.min_contrast) & (sat <= cfg.max_saturated)
    gain = np.where(ok, 1 + cfg.strength * (np.clip(np.median(c[ok]) / np.where(c == 0, 1, c), 1 / cfg.max_gain, cfg.max_gain) - 1), 1)
    off = np.where(ok, cfg.strength * np.clip(np.median(b[ok]) - gain * b, -cfg.max_offset, cfg.max_offset), 0)
    for r in pixels.stabilised(df, cfg).collect():
        want = np.clip(np.rint(stack[r.frame_no] * gain[r.frame_no] + off[r.frame_no]), 0, 255) if ok[r.frame_no] else stack[r.frame_no]
        assert r.usable == ok[r.frame_no] and r.pixels == want.astype(int).tolist()
    one = pixels.quality(df).first()
    assert one.pixel_contrast_std == pytest.approx(stack.std()) and one.frame_brightness_std == pytest.approx(stack.mean(axis=1).std())


def test_validation(spark):
    df = spark.createDataFrame([(1, " ", 0.0, None), (2, "x", -1.0, 5.0), (3, "x", 2.0, 2.0), (4, None, None, None)], "id long, t string, s double, e double")
    got = validation.violations(df, {"blank": validation.blank("t"), **validation.interval_rules("s", "e")}, "id")
    assert rows(got, "id", "rule") == [(1, "blank"), (2, "start_is_negative"), (3, "end_is_not_behind_start"), (4, "blank"), (4, "start_is_negative")]
    with pytest.raises(ValueError, match="blank"):
        validation.raise_if_any(got)


def test_held_out_items_keep_all_rows(spark):
    from tallyline.operators import sampling

    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("c",), (None,)], "item string")
    got = sampling.held_out(df, "item", 2).collect()
    test = {r.item for r in got if r.part == "test"}
    assert len(got) == 6 and len(test) == 2 and None not in test and not test & {r.item for r in got if r.part == "train"}


def test_repetition_of_long_texts(spark):
    """A few comparisons of whole rows: 400,000 tokens, repeated or not, null tokens (which repeat nothing), rows without tokens, and every length around the middle."""
    import time

    rng = random.Random(8)
    long = [str(rng.randrange(3000)) for _ in range(400_000)]
    lists = [long, long[:7] * 50_000, long[:1000] + ["a", "b", "c", "d"] * 100_000, [None] * 6, [None, "a"] * 4, ["a", None, "b"] * 6, [], None]
    want = [False, True, True, True, True, False, False, False]
    edge = [["q%d" % i for i in range(a)] + (list("abcdefghijkl")[:w] * 40)[:m] + ["z%d" % i for i in range(n - a - m)] for n in range(12, 64) for w in (3, 5, 12) for m in (3 * w, -(-3 * n // 5), n) if m <= n for a in {0, (n - m) // 2, n - m}]
    want += [any(c * w >= max(3 * w, 0.6 * len(t)) for w in range(3, 13) for c in [max(r // w + 1 for r in _runs(t, w))]) for t in edge]
    df = spark.createDataFrame(list(enumerate(lists + edge)), "i long, t array<string>")
    begin = time.monotonic()
    got = {r.i: r.r for r in df.select("i", candidates.repetitive(F.col("t")).alias("r")).collect()}
    assert [got[i] for i in range(len(want))] == want and time.monotonic() - begin < 15


def _runs(tokens, w):
    """Lengths of the runs of tokens that repeat the one w before."""
    runs = [0]
    for i in range(w, len(tokens)):
        runs.append(runs[-1] + 1 if tokens[i] == tokens[i - w] else 0)
    return runs


def test_frames_of_chunks_are_not_shuffled(spark):
    """Rows meet by clip before they become frames; clips without chunks, chunks without a clip, empty and outside ones, and equal frames of several chunks."""
    chunks = spark.createDataFrame([(0, 2, 0.4, 0.3, 2.0), (0, 1, -1.0, 1.5, 1.0), (0, 3, 5.0, 1.0, 3.0), (0, 4, 0.2, 0.0, 4.0), (9, 1, 0.0, 1.0, 9.0)], "clip_id long, chunk long, t0 double, seconds double, value double")
    targets = spark.createDataFrame([(0, 0.0, 10), (1, 0.0, 3)], "clip_id long, start double, n int")
    df = timeseries.placed_chunks(chunks, targets, 0.1)
    got = {(r.clip_id, r.k): r.value for r in df.collect()}
    assert got == {(0, k): (1.0 if k < 4 else 2.0 if k < 7 else None) for k in range(10)} | {(1, k): None for k in range(3)}
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.index("Generate") < plan.index("Exchange")
