"""Recognised tokens, runs and document checks: each rule alone, nulls, empty tables; a camera's reads in one micro-batch and in many."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import recognition, records, timeseries
from tallyline.streaming import live, stateful

from .test_stateful import START, frame, passed, stream

WORDS = ["<blank>", "▁he", "l", "lo", "<space>", "▁", "<eos>"]
BEAM = "utterance long, place int, tokens array<int>, score double, forward double, ctc double, frames int"
HEX = "ab" * 32


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], set()).add(r[-1])
    return out


def test_beam_candidates(spark):
    rows = [
        (1, 0, [6, 1, 2, 3, 6], -1.0, None, None, 9), (1, 1, [6, 1, 2, 3, 6, 6], -2.0, float("nan"), None, 9), (1, 2, [6, 5, 6], -3.0, None, None, 9), (1, 3, [6, 1, 4, 3, 6, 6], -4.0, -1.0, -2.0, 4), (1, 4, [6, 2, 6], -5.0, None, None, 9),
        (2, 0, [6, 1, 6], -1.0, None, None, 9), (2, 1, [1, 6], -1.0, None, None, 9), (3, 0, [6, 0, 6], -1.0, None, None, 9), (3, 1, None, -1.0, None, None, 9), (4, 0, [6, 1, 6], None, None, None, 9), (5, 0, [6, 6, 6], None, None, None, 1), (6, 0, [6, 6, 1, 6], 0.0, None, None, 9), (7, 0, [6], 0.0, None, None, 9)]
    got = recognition.beam_candidates(spark.createDataFrame(rows, BEAM), WORDS, 2).orderBy("utterance", "rank").collect()
    assert [(r.utterance, r["rank"], r.text, r.tokens, r.trailing, r.skip, r.issue) for r in got] == [
        (1, 1, "hello", [1, 2, 3], 1, True, None), (1, 2, "he lo", [1, 4, 3], 2, True, None), (2, None, None, None, None, None, "boundary"), (3, None, None, None, None, None, "token"), (4, None, None, None, None, None, "evidence"),
        (6, None, None, None, None, None, "token"), (7, None, None, None, None, None, "boundary")]
    assert [r.forced for r in got[:2]] == [False, True]
    assert recognition.beam_candidates(spark.createDataFrame([], BEAM), WORDS, 2).count() == 0
    with pytest.raises(ValueError):
        recognition.spellings(["a\nb"])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_rates(spark):
    """Against plain loops over random ids with repeats, blanks, padding and empty references."""
    rng = np.random.default_rng(3)
    vocabulary = ["<blank>", "a", "b", "né", "<space>", "c", "<eos>"]
    rows = []
    for i in range(80):
        ref = [int(x) for x in rng.integers(1, 6, rng.integers(0, 9))] if i % 9 else [4, 4]
        hyp = [int(x) for x in np.repeat(rng.integers(0, 6, rng.integers(0, 9)), rng.integers(1, 3))]
        rows.append((i % 2, hyp + [-1] * (i % 3), ref + [-1] * (i % 4)))
    rows += [(2, None, None), (3, [1], []), (4, [1, 99], [1, 2])]
    got = {r.k: r for r in recognition.token_rates(spark.createDataFrame(rows, "k int, hyp array<int>, ref array<int>"), vocabulary, "<space>", "<blank>", "k").collect()}
    for k in (0, 1):
        sums = np.zeros(6)
        for g, hyp, ref in rows[:80]:
            if g != k:
                continue
            n = ref.index(-1) if -1 in ref else len(ref)
            h = "".join(vocabulary[x] for x in hyp[:n]).replace("<space>", " ").replace("<blank>", "")
            r = "".join(vocabulary[x] for x in ref if x != -1).replace("<space>", " ")
            runs = [x for i, x in enumerate(hyp) if i == 0 or x != hyp[i - 1]]
            ch, cr = ("".join(vocabulary[x] for x in ids if x not in (-1, 0, 4)) for ids in (runs, ref))
            c, nc = edits(h.replace(" ", ""), r.replace(" ", "")), len(r.replace(" ", ""))
            sums += [c, nc, edits(h.split(), r.split()), len(r.split()), edits(ch, cr) if cr else 0, len(cr)]
        assert (got[k].cer, got[k].wer, got[k].cer_ctc) == pytest.approx((sums[0] / sums[1], sums[2] / sums[3], sums[4] / sums[5]))
    assert [got[2].cer, got[2].wer, got[2].cer_ctc, got[3].cer, got[3].cer_ctc] == [None] * 5
    assert (got[4].cer, got[4].cer_ctc) == (0.5, 0.5)


def test_runs_and_gates(spark):
    rows = [("x", "base", "你好", "你号", "review", None), ("x", "base", "吗", None, "auto", "failed"), ("x", "new", "你好", "你好！", "review", ""), ("x", "new", "吗", "吧", "retry", None), ("y", "new", "a", "a", None, None)]
    sums = recognition.run_summary(spark.createDataFrame(rows, "s string, run string, reference string, raw string, action string, error string"), "s", "run")
    by = {(r.s, r.run): r for r in sums.collect()}
    assert (by["x", "base"].errors, by["x", "base"].characters, by["x", "base"].exact, by["x", "base"].offered, by["x", "base"].failures) == (2, 3, 0, 1, 1)
    assert (by["x", "new"].errors, by["x", "new"].exact, by["x", "new"].coverage) == (1, 1, 0.5)
    checks = {(r.s, r.check): r.passed for r in recognition.improvements_over(sums, "run", "base", "s").collect()}
    assert checks == {("x", "cer lower"): True, ("x", "exact not lower"): True, ("x", "coverage not lower"): True, ("x", "no failures"): False, **{("y", c): False for c in ("cer lower", "exact not lower", "coverage not lower", "no failures")}}


def test_preset_checks(spark):
    base = [("e", "identity", 0, c, 10, 100, 5, 5, 0) for c in ("clean", "stress")]
    pair = lambda p, i, clean, stress: [("e", p, i, "clean", *clean), ("e", p, i, "stress", *stress)]
    rows = base + pair("good", 2, (10, 100, 5, 5, 0), (8, 100, 5, 5, 0)) + pair("tied", 1, (9, 100, 5, 5, 0), (9, 100, 6, 5, 0)) + pair("same", 3, (10, 100, 9, 9, 0), (10, 100, 9, 9, 0))
    rows += pair("clean", 4, (11, 100, 5, 5, 0), (2, 100, 5, 5, 0)) + pair("exact", 5, (9, 100, 5, 5, 0), (2, 100, 4, 5, 0)) + pair("cover", 6, (9, 100, 5, None, 0), (2, 100, 5, 5, 0)) + pair("fails", 7, (1, 100, 5, 5, 1), (2, 100, 5, 5, 0)) + pair("half", 8, (1, 100, 9, 9, 0), (1, 100, 9, 9, 0))[:1]
    rows += [("f", "identity", 0, "clean", 10, 100, 5, 5, 1), ("f", "better", 1, "clean", 1, 100, 5, 5, 0)]
    got = recognition.preset_checks(spark.createDataFrame(rows, "experiment string, preset string, ord int, condition string, errors long, characters long, exact long, coverage long, failures long"), "identity", "clean")
    by = {r.preset: r for r in got.collect()}
    assert {p for p, r in by.items() if r.eligible} == {"good", "tied"} and {p for p, r in by.items() if r.selected} == {"tied"}
    broken = {p: [c for c in ("pooled_lower", "clean_not_worse", "exact_not_lower", "coverage_not_lower", "no_failures") if not r[c]] for p, r in by.items()}
    assert broken == {"good": [], "tied": [], "same": ["pooled_lower"], "clean": ["clean_not_worse"], "exact": ["exact_not_lower"], "cover": ["coverage_not_lower"], "fails": ["no_failures"], "half": [], "better": ["no_failures"]}


def test_sidecar(spark):
    good = {"provenance": "own", "metadata_verified": False}
    cases = {
        "good": good, "full": good | {"scene": "desk", "capture_type": "real_webcam", "content_style": "read_speech"}, "gone": good, "list": [1], "field": good | {"mood": 1}, "provenance": {"provenance": " ", "metadata_verified": True}, "verified": good | {"metadata_verified": "true"},
        "scene": good | {"scene": None}, "capture": good | {"capture_type": "film"}, "style": good | {"content_style": 3}, "webcam": good | {"capture_type": "real_webcam"}, "cropped": good | {"capture_type": "pre_cropped"}}
    records_ = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()] + [("null", None), ("text", "{")], "id string, record string")
    manifest = spark.createDataFrame([(k, "webcam" if k == "full" else None) for k in [*cases, "null", "text"] if k != "gone"], "id string, domain string")
    assert found(records.sidecar_issues(records_, manifest)) == {
        "gone": {"unknown id"}, "list": {"record"}, "null": {"record"}, "text": {"record"}, "field": {"field"}, "provenance": {"provenance"}, "verified": {"verified"}, "scene": {"scene"}, "capture": {"capture_type"}, "style": {"content_style"}, "webcam": {"webcam"}, "cropped": {"cropped"}}


MODEL = {"name": "n", "language": "zh", "checkpoint_sha256": HEX, "configuration_sha256": HEX, "vocabulary_sha256": HEX, "adapter": None, "beam_size": 4, "nbest": 2, "ctc_weight": 0.1, "reverse_weight": 0, "length_bonus": 0.5, "external_lm": False, "personal": True, "encoder_device": "cpu", "decoder_device": "cpu"}
ADAPTER = {"file_sha256": HEX, "base_checkpoint_sha256": HEX, "schema_version": 1, "language": "zh"}


def test_provenance(spark):
    without = lambda f: {k: v for k, v in MODEL.items() if k != f}
    cases = {
        "name": MODEL | {"name": " "}, "encoder_device": without("encoder_device"), "decoder_device": MODEL | {"decoder_device": 3}, "language": MODEL | {"language": "en"}, "weights": without("checkpoint_sha256"), "configuration_sha256": MODEL | {"configuration_sha256": HEX.upper()}, "vocabulary_sha256": without("vocabulary_sha256"),
        "adapter": without("adapter"), "search": MODEL | {"candidate_pool_size": 5}, "ratio": MODEL | {"pre_beam_ratio": 4.5}, "ctc_weight": MODEL | {"ctc_weight": 1.5}, "reverse_weight": MODEL | {"reverse_weight": True}, "length_bonus": MODEL | {"length_bonus": None}, "external_lm": MODEL | {"external_lm": 0}, "personal": without("personal"),
        "decoder_weights": MODEL | {"decoder_weights": {"ctc": "1"}}, "reverse_scoring": MODEL | {"reverse_scoring": None}, "tolerance": MODEL | {"reverse_tie_tolerance": -1}, "model": [1]}
    fine = {"plain": MODEL, "bound": MODEL | {"adapter": ADAPTER}, "file": without("checkpoint_sha256") | {"file_sha256": HEX}, "more": MODEL | {"decoder_weights": {"ctc": 1, "lm": 0.5}, "reverse_scoring": "batched", "reverse_tie_tolerance": 0, "candidate_pool_size": 3, "pre_beam_ratio": 2}}
    other = {"adapter base": MODEL | {"adapter": ADAPTER | {"base_checkpoint_sha256": "cd" * 32}}, "adapter type": MODEL | {"adapter": ADAPTER | {"schema_version": True}}, "search null": MODEL | {"nbest": None}, "search text": MODEL | {"beam_size": "4"}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in (cases | fine | other).items()], "id string, model string")
    assert found(records.provenance_issues(df, "zh")) == {k: {k} for k in cases} | {k: {k.split()[0]} for k in other}


def test_binding(spark):
    same = [MODEL, dict(reversed(MODEL.items())), MODEL | {"candidate_pool_size": 2, "pre_beam_ratio": 1.5, "reverse_scoring": "sequential", "reverse_tie_tolerance": 0.001, "reverse_weight": 0.0}, MODEL | {"file_sha256": None, "unknown": 5}]
    unlike = [MODEL | {"candidate_pool_size": 3}, MODEL | {"pre_beam_ratio": None}, MODEL | {"adapter": ADAPTER}, MODEL | {"name": "m"}, MODEL | {"reverse_scoring": "batched"}]
    got = [r.b for r in spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(same + unlike)] + [(99, "5"), (100, None)], "i int, m string").select("i", records.model_binding(F.col("m")).alias("b")).orderBy("i").collect()]
    assert len(set(got[:4])) == 1 and len(set(got[:-2])) == 1 + len(unlike) and got[-2:] == [None, None]


def test_frozen_selection(spark):
    good = {"schema_version": 1, "selection_partition": "dev", "test_used_for_selection": False, "selected_preprocessing": "identity", "input_sha256": {"a": HEX}}
    cases = {
        "schema": good | {"schema_version": "1"}, "partition": good | {"selection_partition": None}, "test used": good | {"test_used_for_selection": 0}, "preset": good | {"selected_preprocessing": "sharp"}, "reports": good | {"input_sha256": {"a": HEX, "b": 1}}, "reports 2": good | {"input_sha256": {}}, "reports 3": good | {"provenance": {"dev_report_sha256": {"a": "x"}}},
        "reports 4": good | {"provenance": None}, "reports 5": good | {"provenance": {"dev_report_sha256": [HEX]}}}
    fine = {"good": good, "own": good | {"provenance": {"dev_report_sha256": {"a": HEX}}, "input_sha256": 5}, "empty": good | {"provenance": {"dev_report_sha256": {}}}, "none": good | {"provenance": {"dev_report_sha256": None}}}
    got = found(records.selection_issues(spark.createDataFrame([(k, json.dumps(v)) for k, v in (cases | fine).items()], "id string, document string")))
    assert got == {k: {"test used" if k == "test used" else k.split()[0]} for k in cases}


def test_pictures_and_parameters(spark):
    seed = lambda k: (5 + int.from_bytes(hashlib.sha256(k.encode()).digest()[:8], "big")) % 2**32
    row = lambda k, **c: tuple(({"id": k, "error": None, "configuration": "c", "original": HEX, "input": HEX, "shape": [2, 3, 4], "dtype": "uint8", "seed": seed(k)} | c).values())
    none = dict.fromkeys(("configuration", "original", "input", "shape", "dtype", "seed"))
    left = [row("same"), row("failed", error="x", **none), row("silent", **none), row("left"), row("other", configuration="d"), row("digest", input="x"), row("shape", shape=[1, 2]), row("type", dtype="f4"), row("seed", seed=1), row("unlike", original="cd" * 32), row("null", shape=[1, None, 2])]
    right = [row(r[0]) for r in left if r[0] != "left"] + [row("right")]
    shape = "id string, error string, configuration string, original string, input string, shape array<int>, dtype string, seed long"
    got = found(records.picture_issues(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), (5, 5), ("c", "c")))
    assert got == {"silent": {"a evidence"}, "left": {"unpaired"}, "right": {"unpaired"}, "other": {"a evidence"}, "digest": {"a digest"}, "shape": {"a shape", "different"}, "type": {"a shape", "different"}, "seed": {"a seed", "different"}, "unlike": {"different"}, "null": {"a shape", "different"}}

    want = spark.createDataFrame([("m", n, [2, 3], "f4") for n in "abcdef"], "model string, name string, shape array<int>, dtype string")
    have = spark.createDataFrame([("m", "a", [2, 3], "f4", True), ("m", "b", [3, 2], "f4", True), ("m", "c", [2, 3], "f2", True), ("m", "d", [2, 3], "f4", None), ("m", "e", [2, 3], "f4", True), ("m", "e", [2, 3], "f4", True), ("n", "a", None, None, True)], "model string, name string, shape array<int>, dtype string, finite boolean")
    assert {(r.model, r.name, r.issue) for r in records.parameter_issues(want, have).collect()} == {("m", "b", "shape"), ("m", "c", "type"), ("m", "d", "not finite"), ("m", "e", "repeated"), ("m", "f", "missing"), ("n", "a", "unexpected")}


def test_layer_normed(spark):
    waves = [(0, [1.0, 2.0, 4.0, 8.0], 1), (1, [1.0, None], 2), (2, [], 1), (3, None, 1), (4, [1.0], 0), (5, [1.0], None), (6, [5.0] * 9, 2)]
    got = {r.i: r.w for r in spark.createDataFrame(waves, "i int, w array<double>, n int").select("i", timeseries.layer_normed(F.col("w"), F.col("n"), 3).alias("w")).collect()}
    for i, w, n in waves:
        x = np.array([v or 0.0 for v in (w or [])][: 3 * (n or 0)])
        x = np.pad(x, (0, 3 * (n or 0) - len(x))) if w is not None else x[:0]
        assert got[i] == pytest.approx(list((x - x.mean()) / np.sqrt(x.var() + 1e-5)) if len(x) else [])


@pytest.mark.parametrize("parts", [1, 12])
def test_camera_reads(spark, tmp_path, parts):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(4)), START + int(rng.integers(120_000_000)), i, [True, True, False, None][rng.integers(4)], [False, False, True, None][i // 40 % 4]) for i in range(400)]
    got = live.drained(stateful.camera_reads(stream(frame(spark, rows, "ord long, valid boolean, recording boolean"), tmp_path / "in", parts), "user_id", 3.0, 2.0), spark, str(tmp_path))
    want = []
    for user in range(4):
        good = tracked = None
        for _, us, i, valid, recording in sorted((r for r in rows if r[0] == user and r[1] <= passed(rows, 1_000_000)), key=lambda r: r[1:3]):
            good = us if good is None or valid else good
            if not valid:
                if us - good >= 3_000_000:
                    want.append((user, us, i, "failed"))
                    break
            elif recording or tracked is None or us - tracked >= 2_000_000:
                tracked = us
                want.append((user, us, i, "tracked"))
    assert {w for *_, w in want} == {"failed", "tracked"} and sorted(map(tuple, got.collect())) == sorted(want)


def test_documents_are_read_once_and_in_many_tasks(spark, data):
    """A document is made and parsed once for all its fields, and a small file of rows isn't one task; a filter doesn't go in front of the dealing."""
    from tallyline.plans import suite

    for name in ("val10_model_provenance", "sc46_model_bindings"):
        df = suite.queries()[name](spark, data)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parsejson") == 1
        assert plan.lower().index("parsejson") < plan.index("RepartitionByExpression")
    assert suite.queries()["val10_model_provenance"](spark, data).rdd.getNumPartitions() == 4
