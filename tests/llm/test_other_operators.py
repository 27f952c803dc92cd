import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import multi_index, perspectives, warc_revisits

# --- op4 ------------------------------------------------------------------------------------------------------------

CAPTURE = "record_id long, url string, ts long, etag string, last_modified string, headers map<string,string>, extra int, kind int, stretch int"


def _capture(i, url, ts, etag=None, modified=None, headers=None):
    return (i, url, ts, etag, modified, headers, 1, 2, 3)


def test_canonical_urls(spark):
    pairs = {
        "HTTP://WWW.Example.org:80/a/b/?utm_source=x&b=2&a=1#frag": "example.org/a/b?a=1&b=2", "https://example.org/a/b?a=1&b=2": "example.org/a/b?a=1&b=2", "https://m.example.org/": "m.example.org",
        "https://Example.org?ref=q": "example.org", "": None, "  ": None,
    }
    got = spark.createDataFrame([(k,) for k in pairs], "u string").select("u", warc_revisits.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == pairs


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc_revisits, "STRETCHES", 8)
    rng = np.random.default_rng(5)
    urls = ["http://a.org/x", "https://www.a.org/x/", "http://b.org", None]
    responses = [_capture(i, urls[rng.choice(4, p=[0.6, 0.2, 0.15, 0.05])], int(rng.integers(0, 300)), f'"{rng.integers(3)}"' if rng.random() < 0.8 else None, f"d{rng.integers(2)}" if rng.random() < 0.6 else None, {"Content-Type": "t", "ETag": "o"}) for i in range(200)]
    revisits = [_capture(1000 + i, urls[rng.integers(4)], int(rng.integers(0, 300)) if rng.random() < 0.95 else None, f'W/"{rng.integers(3)}"' if rng.random() < 0.8 else None, f"d{rng.integers(2)}" if rng.random() < 0.6 else None, {"Date": "new", "Content-Length": "0"} if rng.random() < 0.8 else None) for i in range(200)]
    revisits.append(revisits[0])
    key = lambda u: None if u is None else "a.org/x" if "a.org" in u else "b.org"
    want = []
    for i, u, ts, tag, mod, headers, *_ in revisits:
        own = [r for r in responses if key(r[1]) == key(u) is not None and ts is not None and r[2] < ts]
        if not own:
            want.append((i, "no_response", None, None))
            continue
        r = max(own, key=lambda r: (r[2], r[0]))
        ok = tag.removeprefix("W/") == r[3] if tag and r[3] else mod == r[4] if mod and r[4] else True
        merged = {"content-type": "t", "etag": "o"} | ({"date": "new"} if headers else {})
        want.append((i, "resolved" if ok else "validator_mismatch", r[0], merged if ok else None))
    a, b = (spark.createDataFrame(x, CAPTURE) for x in (responses, revisits))
    got = [(r.record_id, r.status, r.response_id, r.headers) for r in warc_revisits.resolved(a, b).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc_revisits.resolved(a.where("false"), b.where("false")).count() == 0
    assert {r.status for r in warc_revisits.resolved(a.where("false"), b).collect()} == {"no_response"}


def test_header_names_that_differ_in_case(spark):
    a = spark.createDataFrame([_capture(1, "http://a.org", 1, None, None, {"ETag": "x", "etag": "y", "Vary": "v", "VARY": "w"})], CAPTURE)
    b = spark.createDataFrame([_capture(2, "http://a.org", 2, None, None, {"Date": "1", "date": "2", "Server": "s"}), _capture(3, None, 2)], CAPTURE)
    got = {r.record_id: (r.status, r.headers) for r in warc_revisits.resolved(a, b).collect()}
    assert got == {2: ("resolved", {"etag": "y", "vary": "v", "date": "2"}), 3: ("no_response", None)}


# --- op5 ------------------------------------------------------------------------------------------------------------


def _brute(rows, queries, k):
    out = {}
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in usable:
        if q in queries:
            found = sorted((-float((x * v).sum() / (np.sqrt((x**2).sum()) * np.sqrt((v**2).sum()))), i) for i, x in {(i, tuple(x)): x for i, x in usable}.items() for i in [i[0]] if i != q)
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [1.0, None] + [0.0] * 6), (604, [1.0]), (605, []), (None, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cell int, grp int")
    queries = set(range(0, 700, 50)) | {3, 503, 7}
    asked = df.where(F.col("vec_id").isin(*queries))
    whole = multi_index.nearest(df, asked.dropDuplicates(["vec_id"]), share=1.0, books=4)
    got = {}
    for r in sorted(whole.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = _brute(rows, queries, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    few = multi_index.nearest(df, asked, share=0.4, least=50).select("query_id", "vec_id").collect()
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, v in want.items() for i, _ in v} for r in few)
    assert hits >= 0.7 * sum(map(len, want.values()))
    assert multi_index.nearest(df.where("false"), df.where("false")).count() == 0
    assert multi_index.nearest(df.where("vec_id in (0, 1)"), df.where("vec_id = 0")).count() == 1


def test_recall_on_the_supplied_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    found = multi_index.nearest(df, df.where("vec_id % 50 = 0"), least=1).collect()
    hits = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & {r.vec_id for r in found if r.query_id == ids[i]})
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_wanted_entries_follow_the_data(spark):
    """Vectors in clusters need a small part of the index, and have nearly all of their neighbours there."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 16)) * 4
    x = centres[rng.integers(0, 200, 6000)] + rng.normal(size=(6000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    plain = multi_index.entries_wanted
    try:
        multi_index.entries_wanted = lambda *a: seen.append(plain(*a)) or seen[-1]
        found = multi_index.nearest(df, df.where("vec_id % 50 = 0"), least=1).collect()
    finally:
        multi_index.entries_wanted = plain
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert seen[0] < 1500 and hits >= 0.9 * 5 * 120


def test_traversal_takes_cells_in_order():
    rng = np.random.default_rng(7)
    left, right, counts = rng.random(9), rng.random(9), rng.integers(0, 4, (9, 9))
    cells = multi_index.traverse(left, right, counts, 40)
    sums = [left[c // 9] + right[c % 9] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells)
    assert sum(counts.ravel()[c] for c in cells[:-1]) < 40 <= sum(counts.ravel()[c] for c in cells)


# --- op6 ------------------------------------------------------------------------------------------------------------


def test_perspectives(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "BUCKET_TURNS", 3)
    rows = [(1, t, ["ann", "bob", "cy d"][t % 3], f"text {t}") for t in range(11)] + [(2, 0, "system", "be kind"), (2, 1, "user", None), (2, 2, None, ""), (2, None, "user", "first"), (2, 1, "user", "tie"), (2, 1, "user", "tie"), (3, 0, "system", "alone"), (None, 0, "user", "x")]
    odd = ["\u5f20\u4e09", "\u674e\u56db", "Jos\u00e9", "Jos_", "a|b", "a%7Cb", None, "%null", "sys tem"]
    rows += [(4, t, x, "odd") for t, x in enumerate(odd)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, start int, perspective string")
    got = {}
    for r in perspectives.rotated(df).collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    shown = lambda name: "%null" if name is None else name.replace("%", "%25").replace("|", "%7C")
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy d"), (2, "user"), (2, "%null"), (None, "user"), *((4, shown(x)) for x in odd)}
    for (conv, who), own in got.items():
        own.sort(key=lambda r: r.start)
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, shown(r[2]), r[3] or ""))
        at = 0
        for (_, t, name, text), r in zip(turns, own, strict=True):
            name = shown(name)
            role = "system" if name == "system" else "assistant" if name == who else "user"
            head = f"<|user name={name}|>\n" if role == "user" else f"<|{role}|>\n"
            segment = head + (text or "") + "<|end|>\n"
            assert (r.turn, r.role, r.name, r.segment, r.start, r.end) == (t, role, name, segment, at, at + len(segment))
            assert (r.mask_start, r.mask_end) == (at + len(head), at + (len(segment) if role == "assistant" else len(head)))
            at += len(segment)
    assert perspectives.rotated(df.where("false")).count() == 0
