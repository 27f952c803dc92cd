"""Stateful operators against plain loops, in one micro-batch and in many, and across a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.streaming import live, stateful

START = 1_700_000_000_000_000


def stream(df, folder, parts):
    path = stateful.time_split(df, "at", str(folder), rows=max(1, df.count() // parts), least=1)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def frame(spark, rows, shape):
    """Rows whose first two values are user and microseconds."""
    return spark.createDataFrame(rows, f"user_id long, us long, {shape}").withColumn("at", F.timestamp_micros("us")).drop("us")


def passed(rows, delay):
    return max(r[1] for r in rows) // 1000 * 1000 - delay


@pytest.mark.parametrize("parts", [1, 12])
def test_delayed_checks(spark, tmp_path, parts):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), START + int(rng.integers(200_000_000)), i, bool(rng.random() < 0.3), f"t{i}" if i % 7 else None) for i in range(300)]
    got = live.drained(stateful.delayed_checks(stream(frame(spark, rows, "ord long, opens boolean, text string"), tmp_path / "in", parts), "user_id"), spark, str(tmp_path))
    want = []
    for user, us, i, opens, _ in rows:
        for n, d in enumerate((4, 12, 30), 1):
            due = us + d * 1_000_000
            if opens and due <= passed(rows, 1_000_000):
                seen = [(r[1], r[2], r[4]) for r in rows if r[0] == user and not r[3] and (us, i) < (r[1], r[2]) and r[1] <= due]
                want.append((user, i, n, due, max(seen)[2] if seen else None))
    assert len(want) > 150 and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_checks_go_on_after_a_restart(spark, tmp_path):
    """A watch opened before the stream was stopped is checked after it began again, each check once."""
    rows = [(1, START, 0, True, "a"), (1, START + 3_000_000, 1, False, "b"), (1, START + 6_000_000, 2, False, "c")]
    more = [(1, START + 20_000_000, 3, False, "d"), (1, START + 60_000_000, 4, False, "e")]
    shape = "ord long, opens boolean, text string"
    run = lambda: live.drained(stateful.delayed_checks(spark.readStream.schema(frame(spark, rows, shape).schema).parquet(str(tmp_path / "in")), "user_id"), spark, str(tmp_path)).orderBy("number").collect()
    frame(spark, rows, shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert [(r.number, r.seen) for r in run()] == [(1, "b")]
    frame(spark, more, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert [(r.number, r.seen) for r in run()] == [(1, "b"), (2, "c"), (3, "d")]


@pytest.mark.parametrize("parts", [1, 10])
def test_nearest_match(spark, tmp_path, parts):
    """Ties (times on a grid of 20 ms), gaps, frames before any audio and users without it."""
    rng = np.random.default_rng(2)
    left = [(int(rng.integers(3)), START + 20_000 * int(rng.integers(1000)), i) for i in range(150)]
    right = [(int(rng.integers(2)), START + 20_000 * int(rng.integers(1000)), i) for i in range(150)]
    streams = [stream(frame(spark, rows, "ord long"), tmp_path / f"in{k}", parts) for k, rows in enumerate((left, right))]
    got = live.drained(stateful.nearest_match(*streams, "user_id", 0.06, 0.2), spark, str(tmp_path))
    want, end = [], min(passed(left, 1_000_000), passed(right, 1_000_000))
    for user, us, i in left:
        target = us - 60_000
        near = sorted((abs(r[1] - target), r[1], r[2]) for r in right if r[0] == user and abs(r[1] - target) <= 200_000)
        if target + 200_000 <= end:
            want.append((user, i, near[0][2], near[0][1] - target) if near else (user, i, None, None))
    assert sum(w[2] is None for w in want) > 10 and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def gestures(rows):
    """Clean taps of one user's rows (us, ord, generation, kind, code, modified, again), looking at whole taps."""
    rows, out, newest, kept = sorted(rows), [], None, []
    for r in rows:
        if r[2] is not None and (newest is None or r[2] >= newest):
            newest = r[2]
            kept.append(r)
    for g in sorted({r[2] for r in kept}):
        own, held, press = [r for r in kept if r[2] == g], set(), None
        for n, (us, i, _, kind, code, modified, again) in enumerate(own):
            if kind == "press" and press is None:
                press = (n, not held and not modified)
            elif kind == "release" and press is not None:
                between = own[press[0] + 1 : n + 1]
                quiet = all(b[3] not in ("key_down", "button_down", "scroll", "modifier") and not b[5] for b in between)
                if press[1] and quiet and 25_000 <= us - own[press[0]][0] <= 500_000:
                    out.append((us, i, "toggle"))
                press = None
            elif kind.endswith("_down"):
                name = (kind[:-5], code)
                if name == ("key", 53) and name not in held and not again:
                    out.append((us, i, "cancel"))
                held.add(name)
            elif kind.endswith("_up"):
                held.discard((kind[:-3], code))
    return out


TAPS = "ord long, generation long, kind string, code int, modified boolean, again boolean"


@pytest.mark.parametrize("parts", [1, 12])
def test_clean_taps(spark, tmp_path, parts):
    rng = np.random.default_rng(3)
    kinds = ["press", "release"] * 5 + ["key_down", "key_up", "key_up", "button_down", "button_up", "scroll", "modifier"]
    rows, us = [], START
    for i in range(400):
        us += int(rng.choice([5_000, 25_000, 100_000, 500_000]))
        generation = None if i % 97 == 0 else i // 150 - (i % 31 == 0)
        rows.append((int(rng.integers(2)), us, i, generation, str(rng.choice(kinds)), int(rng.integers(52, 55)), bool(rng.random() < 0.05), bool(rng.random() < 0.3)))
    rows += [(9, us + 25_000 * k, 400 + k, 5, kind, 0, False, False) for k, kind in enumerate(["press", "release", "press", "scroll", "release", "key_down", "press", "release", "key_up", "press", "release"])]
    rows.append((8, us + 90_000_000, 500, 0, "scroll", 0, False, False))
    got = live.drained(stateful.clean_taps(stream(frame(spark, rows, TAPS), tmp_path / "in", parts), "user_id"), spark, str(tmp_path))
    want = [(u, *x) for u in (0, 1, 8, 9) for x in gestures([r[1:] for r in rows if r[0] == u])]
    assert {"toggle", "cancel"} == {w[3] for w in want} and sorted(map(tuple, got.collect())) == sorted(want)
    assert [w[2] for w in want if w[0] == 9] == [401, 410]


@pytest.mark.parametrize("parts", [1, 8])
def test_drafts_and_finals(spark, tmp_path, parts):
    rng = np.random.default_rng(4)
    rows = [(0, START + int(rng.integers(1000)), int(rng.integers(20)) if i % 50 else None, str(rng.choice(["draft", "draft", "final", "edit", "odd"])), int(rng.integers(30)), f"t{i}" if i % 40 else None) for i in range(200)]
    df = frame(spark, rows, "token long, kind string, version long, text string")
    got = stateful.upserted(stream(df, tmp_path / "in", parts), str(tmp_path / "out"))
    want = {}
    for _, _, token, kind, version, text in rows:
        if token is not None and kind in stateful.RANK and text is not None:
            want[token] = max(want.get(token, (-1,)), (stateful.RANK[kind], version, text))
    assert {r.token: (r["rank"], r.version, r.text) for r in got.collect()} == want
    # all once more, after a restart: nothing changes
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = stateful.upserted(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    assert {r.token: (r["rank"], r.version, r.text) for r in again.collect()} == want


@pytest.mark.parametrize("parts", [1, 20])
def test_rates_and_dictations_in_any_batches(spark, tmp_path, parts):
    rng = np.random.default_rng(5)
    times = np.cumsum(rng.choice([0.1, 0.2, 0.3, 0.4, 1.0], 300))
    rows = [(1, float(t), str(rng.choice(["down", "up", "down", "up", "other", "esc"])), i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "user_id long, ts double, kind string, ord long").withColumn("at", F.col("ts"))
    got = live.drained(live.dictation_actions(stream(df, tmp_path / "in", parts)), spark, str(tmp_path / "a")).orderBy("ts").collect()
    state, want, last, let = dict(live._START), [], float("-inf"), []
    for _, t, kind, i in rows:
        state, acts = live.step(state, kind, t)
        want += [(t, a) for a in acts]
        if t - last >= 0.5:
            last = t
            let.append(i)
    assert [(r.ts, r.action) for r in got] == want
    assert [r.ord for r in live.drained(live.rate_limited(stream(df, tmp_path / "in2", parts), 0.5), spark, str(tmp_path / "b")).orderBy("ord").collect()] == let


def test_batches_stay_few_as_rows_grow_and_hold_few_rows_of_a_key(spark, tmp_path):
    rows = [(i % 50, START + i, i) for i in range(6000)] + [(99, START + 4 * i, i) for i in range(900)]
    df = frame(spark, rows, "ord long")
    count = lambda d, n, **most: stateful.files_a_trigger(spark.read.schema(d.schema).parquet(stateful.time_split(d, "at", str(tmp_path / f"f{n}"), rows=300)), "user_id", **most)
    assert count(df.where("user_id < 50"), 1) == 5  # 20 files, 4 batches
    assert count(df, 2, most=200) in (2, 3)
    assert count(df, 3, most=1) == 1


def test_many_users_share_groups_of_state(spark, tmp_path, monkeypatch):
    """Users of one group, and rows without a user, don't disturb each other, and a worker is called for groups, not for users."""
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(40)) if i % 9 else None, float(rng.integers(3000)) / 10, str(rng.choice(["down", "up", "down", "up", "other", "esc"])), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id long, ts double, kind string, ord long").withColumn("at", F.col("ts"))
    monkeypatch.setattr(live, "GROUPS", 3)
    want, let = [], []
    for user in {r[0] for r in rows}:
        state, last = dict(live._START), float("-inf")
        for _, t, kind, i in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1], r[3])):
            state, acts = live.step(state, kind, t)
            want += [(user, t, a) for a in acts]
            if t - last >= 0.5:
                last = t
                let.append((user, t, i))
    got = live.drained(live.dictation_actions(stream(df, tmp_path / "in", 5)), spark, str(tmp_path / "a"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    got = live.drained(live.rate_limited(stream(df, tmp_path / "in2", 5), 0.5), spark, str(tmp_path / "b"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, let))


@pytest.mark.parametrize("parts", [1, 6])
def test_many_keys_share_groups_of_timed_state(spark, tmp_path, monkeypatch, parts):
    """Keys of one group, here texts, wait, remember and expire each by itself, and state has a row for groups, not for keys."""
    monkeypatch.setattr(stateful, "GROUPS", 3)
    rng = np.random.default_rng(8)
    rows = [(f"u{rng.integers(60)}" if i % 9 else None, START + 1000 * int(rng.integers(200_000)), i, bool(rng.random() < 0.6)) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id string, us long, ord long, valid boolean").withColumns({"at": F.timestamp_micros("us"), "recording": F.lit(False)}).drop("us")
    own = stateful.camera_reads(stream(df, tmp_path / "in", parts), "user_id", 3.0, 2.0)
    query = own.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3
    want, end = [], passed(rows, 1_000_000)
    for user in {r[0] for r in rows if r[0]}:
        good = tracked = None
        for _, us, i, valid in sorted((r for r in rows if r[0] == user and r[1] <= end), key=lambda r: r[1:3]):
            good = us if good is None or valid else good
            if not valid and us - good >= 3_000_000:
                want.append((user, us, i, "failed"))
                break
            if valid and (tracked is None or us - tracked >= 2_000_000):
                tracked = us
                want.append((user, us, i, "tracked"))
    assert {"failed", "tracked"} == {w[3] for w in want}
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)
