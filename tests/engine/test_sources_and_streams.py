import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline.operators import timeseries
from tallyline.sources import readers, sinks
from tallyline.streaming import live


def test_manifests_fail_closed(spark, tmp_path):
    doc = {"schema_version": 1, "split": "test", "samples": [{"id": "a", "reference": "x"}, {"id": "b", "start": 2.0, "end": 3.5}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=1))
    header, own = readers.manifest(spark, str(tmp_path / "m.json"))
    assert header.first().split == "test" and [(r.ord, r.id, r.start, r.end) for r in own.orderBy("ord").collect()] == [(0, "a", 0.0, None), (1, "b", 2.0, 3.5)]
    (tmp_path / "m.json").write_text(json.dumps(doc | {"schema_version": 2}))
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "m.json"))


def test_files(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.bin").write_bytes(b"abc")
    got = readers.file_hashes(spark, str(tmp_path)).first()
    assert got.sha256 == hashlib.sha256(b"abc").hexdigest() and readers.folder_bytes(spark, str(tmp_path)).first().bytes == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.csv", "id,t\n1,a\n")
        z.writestr("other", "no")
    m = readers.zip_members(spark, str(tmp_path / "z.zip"), ["x.csv"], 100).collect()
    assert [(r.name, bytes(r.content)) for r in m] == [("x.csv", b"id,t\n1,a\n")]
    with pytest.raises(Exception, match="over 3 bytes"):
        readers.zip_members(spark, str(tmp_path / "z.zip"), ["x.csv"], 3).collect()
    (tmp_path / "w.txt").write_text("# head\n\nAnna\n  Bob \n")
    assert [r.word for r in readers.word_list(spark, str(tmp_path / "w.txt")).collect()] == ["Anna", "Bob"]
    (tmp_path / "v.txt").write_text("a 1\nbb 2\nb 3\n")
    assert {r.character for r in readers.vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {"a", "b"}
    (tmp_path / "c.csv").write_text("﻿ID,T\n1,x\n")
    assert readers.headed_csv(spark, str(tmp_path / "c.csv")).columns == ["ID", "T"]


def test_subtitles_to_sentences(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,500\nThis is <i>one</i>\nlong\n\n2\n00:00:02,500 --> 00:00:04,000\nsentence here.\n\n3\n00:01:00,000 --> 00:01:01,000\nToo short.\n")
    cues = readers.cues(spark, str(tmp_path / "a.srt"))
    assert [(r.start, r.end, r.text) for r in cues.orderBy("cue").collect()][0] == (1.0, 2.5, "This is one long")
    got = timeseries.sentences(cues).collect()
    assert [(r.text, r.start, r.end, r.words) for r in got] == [("This is one long sentence here.", 1.0, 4.0, 6)]


def test_text_columns(spark):
    df = spark.createDataFrame([(f"these are some spoken words {i}", f"/a/b/{i}", "{}") for i in range(10)], "said string, path string, js string")
    assert [r.column for r in readers.text_columns(df).collect()] == ["said"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 10)], "a long, n long")
    sinks.publish(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        sinks.publish(df, str(tmp_path / "in"), (str(tmp_path / "in") + "/",))
    with pytest.raises(ValueError):
        sinks.append_within(df, str(tmp_path / "q"), 95, 100, "n")
    sinks.report({"b": 1, "a": 2}, str(tmp_path / "r/x.json"))
    assert (tmp_path / "r/x.json").read_text() == '{"a": 2, "b": 1}'
    with pytest.raises(ValueError):
        sinks.report({"a": float("nan")}, str(tmp_path / "r/x.json"))
    assert sinks.fingerprint({"a": 1, "b": 2}) == sinks.fingerprint({"b": 2, "a": 1})


def run(keys):
    state, out = dict(live._START), []
    for ts, kind in keys:
        state, acts = live.step(state, kind, ts)
        out += acts
    return out


def test_push_to_talk():
    assert run([(0, "down"), (1, "up")]) == ["start", "stop"]
    assert run([(0, "down"), (0.1, "up")]) == ["start", "cancel_silent"]
    assert run([(0, "down"), (0.25, "up")]) == ["start", "stop"]
    assert run([(0, "down"), (0.1, "up"), (0.2, "down"), (0.3, "up"), (5, "down"), (5.1, "up")]) == ["start", "cancel_silent", "start", "start_hands_free", "stop"]
    assert run([(0, "down"), (0.1, "up"), (0.45, "down"), (0.55, "up")]) == ["start", "cancel_silent", "start", "cancel_silent"]
    assert run([(0, "down"), (0.5, "other"), (1, "up")]) == ["start", "cancel"]
    assert run([(0, "down"), (0.5, "esc"), (1, "up")])[:2] == ["start", "cancel"]
    assert run([(0, "down"), (0.2, "down"), (1, "up")]) == ["start", "stop"]


def test_streams_keep_state_between_batches(spark, tmp_path):
    keys = [(1, float(t), k, i) for i, (t, k) in enumerate([(0, "down"), (1, "up"), (5, "down"), (7, "up")])]
    schema = "user_id long, ts double, kind string, ord long"
    for i, r in enumerate(keys):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = live.drained(live.dictation_actions(stream), spark, str(tmp_path / "s")).orderBy("ts").collect()
    assert [(r.ts, r.action) for r in got] == [(0.0, "start"), (1.0, "stop"), (5.0, "start"), (7.0, "stop")]


def test_tails_and_duplicates(spark, tmp_path):
    frames = spark.createDataFrame([(1, f"2026-01-01 00:00:0{s}") for s in ("1.0", "2.2", "2.39", "2.5")], "user_id long, at string").withColumn("at", F.to_timestamp("at"))
    stops = spark.createDataFrame([(1, "2026-01-01 00:00:02")], "user_id long, stop_at string").withColumn("stop_at", F.to_timestamp("stop_at"))
    assert live.tails(frames, stops, 0.4, "10 seconds").count() == 2
    frames.withColumn("kind", F.lit("x")).union(frames.withColumn("kind", F.lit("x"))).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema("user_id long, at timestamp, kind string").parquet(str(tmp_path / "d"))
    assert live.drained(live.deduplicated(stream, "1 minute"), spark, str(tmp_path / "s2")).count() == 4


def test_a_bounded_buffer_needs_no_state(spark):
    """Sums over stretches are the running ones, also of a user with most events, and no task holds all of a user's rows."""
    from tallyline.streaming import live

    rows = [(1 if i % 10 else 2 + i % 3, i, float(i % 7 == 0) if i % 10 else float(i % 50)) for i in range(12_000)]
    got = live.bounded(spark.createDataFrame(rows, "user_id long, ord long, seconds double").repartition(5), 1000.0)
    assert "Pandas" not in got._jdf.queryExecution().toString()
    want, used = {}, {}
    for user, i, s in rows:
        want[user, i] = max(0.0, min(s, 1000.0 - used.get(user, 0.0)))
        used[user] = used.get(user, 0.0) + want[user, i]
    assert {(r.user_id, r.ord): r.kept for r in got.collect()} == want
