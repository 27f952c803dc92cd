"""Frames, decoder scores, checkpoints and archives against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import decoding, pixels, warps

H, W = 9, 7


def mirror(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * n - 2 - i
    return i


def whole(x):
    return max(0, min(255, round(x)))


def naive_stress(frame, gain, s):
    h, w = len(frame), len(frame[0])
    if s.downsample != 1:
        sh, sw = max(2, round(h * s.downsample)), max(2, round(w * s.downsample))
        cover = lambda k, i, n, m: max(0.0, min((k + 1) * n / m, i + 1) - max(k * n / m, i)) / (n / m)
        small = [[whole(sum(frame[i][j] * cover(y, i, h, sh) * cover(x, j, w, sw) for i in range(h) for j in range(w))) for x in range(sw)] for y in range(sh)]

        def at(k, n, m):
            p = min(max((k + 0.5) * m / n - 0.5, 0), m - 1)
            return int(p), min(int(p) + 1, m - 1), p - int(p)

        frame = []
        for y in range(h):
            a, b, v = at(y, h, sh)
            frame.append([])
            for x in range(w):
                c, d, u = at(x, w, sw)
                frame[-1].append(whole((small[a][c] * (1 - u) + small[a][d] * u) * (1 - v) + (small[b][c] * (1 - u) + small[b][d] * u) * v))
    if s.blur_sigma:
        reach = int(round(s.blur_sigma * 6 + 1) | 1) // 2
        g = [math.exp(-k * k / 2 / s.blur_sigma**2) for k in range(-reach, reach + 1)]
        frame = [[whole(sum(frame[mirror(y + i, h)][mirror(x + j, w)] * g[i + reach] * g[j + reach] for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)) / sum(g) ** 2) for x in range(w)] for y in range(h)]
    return [whole(((p - 127.5) * s.contrast_gain + 127.5) * gain + s.exposure_offset) for row in frame for p in row]


def frames(spark, depth=1, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(c, int(n), rng.integers(0, 256, H * W * depth).tolist()) for c, many in ((1, 5), (2, 3)) for n in rng.permutation(many) * 3000]
    return [*rows, (2, 99_000, None), (2, 99_001, [1, 2])], spark.createDataFrame([*rows, (2, 99_000, None), (2, 99_001, [1, 2])], "clip_id int, frame_no int, pixels array<int>").repartition(3)


@pytest.mark.parametrize("name", ["clean", "synthetic_mild", "synthetic_moderate"])
def test_stress(spark, name):
    rows, df = frames(spark)
    got = {(r.clip_id, r.frame_no): r.pixels for r in warps.stressed(df, warps.STRESS[name], H, W, seed=7).collect()}
    phase, s = np.random.default_rng(7).uniform(0, 2 * np.pi), warps.STRESS[name]
    assert len(got) == len(rows)
    for clip, number, p in rows:
        order = sorted(n for c, n, _ in rows if c == clip)
        gain = s.exposure_gain * (1 + s.exposure_amplitude * math.sin(2 * math.pi * order.index(number) / len(order) + phase))
        if name == "clean":
            assert got[clip, number] == p
        elif p is None or len(p) != H * W:
            assert got[clip, number] is None
        else:
            # a value half-way between two may go either way by the last bit
            want = naive_stress([p[i * W : i * W + W] for i in range(H)], gain, s)
            assert max(abs(a - b) for a, b in zip(got[clip, number], want, strict=True)) <= 1 and sum(a != b for a, b in zip(got[clip, number], want, strict=True)) <= 2


def test_stress_then_stabilise_and_bounds(spark):
    _, df = frames(spark)
    df = df.where("size(pixels) > 2")
    two = pixels.stabilised(warps.stressed(df, warps.STRESS["synthetic_mild"], H, W), warps.STABILISATION["stabilize_mild"])
    assert sorted(map(str, warps.stressed_then_stabilised(df, "synthetic_mild", "stabilize_mild", H, W).collect())) == sorted(map(str, two.collect()))
    for bad in (dict(downsample=0.2), dict(blur_sigma=float("nan")), dict(exposure_gain=True), dict(contrast_gain=2)):
        with pytest.raises(ValueError):
            warps.checked(warps.Stress(**bad))


def test_crop_grid(spark):
    rows, df = frames(spark, 3)
    crops = warps.CROPS | {"all": warps.Crop(1.3, 1.5, -2.25, True, True)}
    got = {(r.clip_id, r.frame_no, r.crop): r.pixels for r in warps.crop_grid(df, H, W, crops).collect()}
    assert len(got) == len(rows) * len(crops) and len(warps.CROPS) == 12
    for clip, number, p in rows:
        for name, c in crops.items():
            if p is None or len(p) != H * W * 3:
                assert got[clip, number, name] is None
                continue
            b, g, r = warps.FINE_GREY if c.fine else warps.GREY
            grey = [[p[3 * (i * W + j)] * b + p[3 * (i * W + j) + 1] * g + p[3 * (i * W + j) + 2] * r for j in range(W)] for i in range(H)]
            grey = grey if c.fine else [[whole(x) for x in row] for row in grey]
            grey = [row[::-1] for row in grey] if c.mirror else grey
            want = []
            for y in range(H):
                for x in range(W):
                    v, u = (y - (H - 1) / 2 - c.dy) / c.scale + (H - 1) / 2, (x - (W - 1) / 2 - c.dx) / c.scale + (W - 1) / 2
                    i, j = math.floor(v), math.floor(u)
                    at = lambda a, d: grey[mirror(a, H)][mirror(d, W)]  # noqa: B023, E731
                    z = (at(i, j) * (1 - u + j) + at(i, j + 1) * (u - j)) * (1 - v + i) + (at(i + 1, j) * (1 - u + j) + at(i + 1, j + 1) * (u - j)) * (v - i)
                    want.append(z if c.fine else whole(z))
            assert max(abs(a - d) for a, d in zip(got[clip, number, name], want, strict=True)) <= (1e-9 if c.fine else 1)


def test_reverse_scores(spark):
    logp = [[-(t * 7 + v) / 10 for v in range(6)] for t in range(4)]
    rows = [(1, 0, [2, 3, 1]), (1, 1, []), (1, 2, [4]), (1, 3, None), (1, 4, [5]), (1, 5, [0]), (1, 6, [1, None]), (2, 7, []), (3, 8, [1, 1, 1, 1])]
    df = decoding.reversed_inputs(spark.createDataFrame(rows, "g int, i int, tokens array<int>"), "g", "tokens", 5)
    got = {r.i: r for r in df.withColumn("score", decoding.gathered_score(F.from_json(F.lit(str(logp)), "array<array<double>>"), F.col("targets"), F.col("valid"))).collect()}
    assert (got[0].inputs, got[0].targets, got[0].valid) == ([5, 1, 3, 2], [1, 3, 2, 5], [True] * 4)
    assert (got[1].inputs, got[1].targets, got[1].valid) == ([5, 0, 0, 0], [5, 0, 0, 0], [True, False, False, False])
    assert got[7].targets == [5] and all(got[i].targets is None and got[i].score is None for i in (3, 4, 5, 6))
    for g, i, body in rows:
        if got[i].targets is not None and i != 8:
            assert got[i].score == pytest.approx(sum(logp[t][v] for t, v in enumerate([*body[::-1], 5])))
    assert got[8].score is None  # five places, four rows of log-probabilities
    odd = spark.createDataFrame([([[float("nan"), 0.0]], [0], [True]), ([[0.5, None]], [1], [True]), ([[0.5, float("-inf")]], [0], [True]), ([[0.5]], [1], [True]), ([[0.5], [float("nan")]], [0, 0], [True, False])], "l array<array<double>>, t array<int>, v array<boolean>")
    assert [r[0] for r in odd.select(decoding.gathered_score(F.col("l"), F.col("t"), F.col("v"))).collect()] == [None, None, 0.5, None, 0.5]


def test_beam_step_is_the_full_sort(spark):
    rng = np.random.default_rng(3)
    hyps = [(u, h, float(rng.integers(3))) for u in range(6) for h in range(1 + u)] + [(0, 9, None), (0, 8, float("nan"))]
    steps = [(u, h, t, float(rng.integers(4)), float(rng.integers(5))) for u, h, _ in hyps for t in range(30)] + [(1, 0, 99, None, 9.0), (1, 0, 98, 9.0, float("nan")), (7, 0, 1, 1.0, 1.0)]
    want = []
    for u in range(6):
        every = []
        for _, h, s in (x for x in hyps if x[0] == u and x[2] is not None and x[2] == x[2]):
            own = sorted((x for x in steps if x[:2] == (u, h) and x[3] is not None and x[4] == x[4]), key=lambda x: (-x[3], x[2]))[: int(1.5 * 5)]
            every += [(-(s + x[4]), h, x[2]) for x in own]
        want += [(u, n + 1, h, t, -s) for n, (s, h, t) in enumerate(sorted(every)[:5])]
    got = decoding.beam_step(spark.createDataFrame(hyps, "utterance int, hypothesis int, score double"), spark.createDataFrame(steps, "utterance int, hypothesis int, token int, first double, full double"), 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_resume_issues(spark):
    run = lambda name, *rows: [(name, n, e, i, t, 100.0) for n, (e, i, t) in enumerate(rows)]
    nan = float("nan")
    rows = run("fine", (1, "a", 10.0), (2, "a", 20.0), (3, "a", 100.0)) + run("late", (2, "a", 1.0), (3, "a", 2.0)) + run("mixed", (1, "a", 10.0), (2, "b", 20.0), (4, "a", 15.0), (4, "a", 101.0), (5, "a", 50.0), (None, "a", nan), (6, None, -1.0))
    df = spark.createDataFrame(rows, "run string, step int, epoch int, identity string, elapsed double, budget double")
    assert sorted(map(tuple, decoding.resume_issues(df).collect())) == sorted([
        ("late", 0, "start"), ("mixed", 1, "identity"), ("mixed", 2, "gap"), ("mixed", 2, "back"), ("mixed", 3, "repeat"), ("mixed", 3, "overdrawn"), ("mixed", 4, "back"), ("mixed", 4, "overdrawn"), ("mixed", 5, "gap"), ("mixed", 5, "clock"), ("mixed", 6, "identity"), ("mixed", 6, "clock")])
    assert decoding.resume_issues(df.where("false")).collect() == []


def test_archive_members(spark):
    members = spark.createDataFrame([(n,) for n in ["top/a/b/x.mp4", "a/b/x.mp4", "c/y.mp4", "c/y.mp4", "other/ay.mp4", None, "z", "q//w"]], "name string")
    wanted = spark.createDataFrame([(1, ["a/b/x.mp4"]), (2, ["c/y.mp4", "zz"]), (3, ["y.mp4"]), (4, ["no.mp4", None, ""]), (5, None), (6, ["top/a/b/x.mp4"]), (7, ["z"]), (8, ["w"]), (9, ["y.mp4", "z"])], "id int, paths array<string>")
    got = {r.id: (r.status, r.member, r.n) for r in decoding.archive_members(members, wanted).collect()}
    assert got == {1: ("several", None, 2), 2: ("one", "c/y.mp4", 1), 3: ("one", "c/y.mp4", 1), 4: ("missing", None, 0), 5: ("missing", None, 0), 6: ("one", "top/a/b/x.mp4", 1), 7: ("one", "z", 1), 8: ("one", "q//w", 1), 9: ("several", None, 2)}


def test_quantiles_are_those_of_sql_to_the_last_place(spark):
    import duckdb

    rng = np.random.default_rng(11)
    rows = [(i, sorted(int(x) for x in rng.integers(0, 256, 64))) for i in range(600)] + [(600, [49] * 6 + [49, 50] + [60] * 56), (601, [7])]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    got = {r.i: tuple(r)[1:] for r in df.select("i", *(pixels.quantile(F.col("v"), q).alias(f"q{n}") for n, q in enumerate((0.1, 0.5, 0.9)))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v INTEGER[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.execute("SELECT i, " + ", ".join(f"quantile_cont(CAST(p AS DOUBLE), {q})" for q in (0.1, 0.5, 0.9)) + " FROM (SELECT i, unnest(v) AS p FROM t) GROUP BY 1").fetchall()
    assert got == {r[0]: r[1:] for r in want}
