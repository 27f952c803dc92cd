import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm.char_tagger import PAD, Tagger, encode, tag_spans
from tallyline.llm import byte_cnn, cost_packing, cube_mixing, jaccard_join, pii, quality_forest, repair_codec
from tallyline.llm.common import components, text_chunks, word_tokenizer, hash_sample, thinned

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_tokenizer_gives_the_library_s_ids(docs, tokenizer):
    texts = [r.text or "" for r in docs.collect()] + ["".join(np.random.default_rng(i).choice(list("ab1.'!é×ßÉ ½ñ\n\x85<|x"), 40)) for i in range(200)]
    own = word_tokenizer()
    got = []
    for _, data, offsets in text_chunks(pa.array(texts)):
        ids, begins = own.encode(data, offsets, 7)
        got += [ids[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    own.met[:] = 1
    own._shrink()
    assert len(own.names) == 0


def test_components(spark):
    edges = [(1, 5), (5, 9), (9, 1), (20, 21), (7, 7), (30, 31), (31, 32), (32, 33), (33, 34)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 5: 1, 9: 1, 20: 20, 21: 20, **{i: 30 for i in range(30, 35)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op1 ------------------------------------------------------------------------------------------------------------


def test_mixing(docs, none):
    found = cube_mixing.mixed(docs).collect()
    assert len(found) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(order, [5, 2, 1, 5, 2, 1], strict=False))
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * rate >= 3 * sizes[s]}
        if not full:
            target |= {s: weight[s] * rate for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r["copies"] * r.size
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, cube_mixing.mixed(docs.repartition(2)).collect()), key=str)
    assert cube_mixing.mixed(none).count() == 0


def test_mixing_comes_near_targets_over_several_rounds(spark, data, monkeypatch):
    monkeypatch.setattr(cube_mixing, "BLOCK_ROWS", 16)
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pmod(xxhash64(id), 300) as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    sums = cube_mixing.mixed(big).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t"), F.sum("copies").alias("c"), F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    for r in sums:
        assert abs(r.k - r.t) <= 0.01 * r.t + 60
        assert abs(r.c - r.n * r.t / r.s) <= 3


def test_mixing_lands_a_small_source_of_long_documents_beside_a_hot_one(spark, monkeypatch):
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pmod(xxhash64(id), 300) as int))").alias("text"), F.lit("hot").alias("source"))
    for i in range(3):
        small = spark.range(60).select((F.col("id") + 10_000 * (i + 1)).alias("doc_id"))
        small = small.select("doc_id", F.expr("repeat('w ', cast(1 + pmod(xxhash64(doc_id), 20000) as int))").alias("text"), F.lit(f"small{i}").alias("source"))
        hot = hot.unionByName(small)
    found = cube_mixing.mixed(hot).collect()
    taken = {s: sum(r.taken for r in found if r.source == s) for s in ("hot", "small0", "small1", "small2")}
    target = {r.source: r.target for r in found}
    assert len(found) == 5180 and abs(taken["hot"] - target["hot"]) <= 0.001 * target["hot"]
    # the small ones land as they do where no source is cut into blocks
    monkeypatch.setattr(cube_mixing, "BLOCK_ROWS", 1_000_000)
    alone = {r.doc_id: r["copies"] for r in cube_mixing.mixed(hot).collect()}
    assert all(alone[r.doc_id] == r["copies"] for r in found if r.source != "hot")


def test_flight_stays_in_the_null_space():
    rng = np.random.default_rng(0)
    size, p = rng.integers(0, 500, 400), np.full(400, 0.37)
    q = cube_mixing.flight(size, p, rng.random(400))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and (size * q).sum() == pytest.approx((size * p).sum(), abs=1e-3)
    assert set(cube_mixing.land(size, q)) <= {0.0, 1.0}


# --- op2 ------------------------------------------------------------------------------------------------------------


def _naive(x):
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p, ok: [m.span() for m in re.finditer(p, x) if ok(m[0])]
    return {
        "email": find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), "ip": find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": find(r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s))), "phone": find(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        x = "".join(rng.choice(list("0123459@@.a-b+ ()é\n"), rng.integers(0, 40)))
        assert pii.base_spans(x) == _naive(x)
    assert pii.base_spans("9" * 6000 + "." + "1.1.1")["ip"] == []
    assert len(pii.base_spans("a" * 200_000 + "@b.c " + "+" * 1000)["email"]) == 1


def test_personal_data(docs, none):
    found = pii.personal_data(docs, steps=5).collect()
    assert len(found) == docs.count()
    import hashlib

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found:
        own = _naive(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(own[k]) for k in pii.BASE]
        base = pii.joined(own)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert set(filter(None, base.split(","))) <= set(spans) and r.n_spans == len(spans) == r.n_added + len([x for x in base.split(",") if x])
    assert pii.personal_data(none, steps=2).count() == 0


@pytest.fixture(scope="module")
def tagger():
    return pii.trained([], 350)


def test_tagger_finds_written_out_variants(tagger):
    rng = np.random.default_rng(77)
    texts, gold = [], []
    for _ in range(400):
        before, middle, behind, kind = pii._variants(rng)
        texts.append("and then the " + before + middle + behind + " of what was")
        at = 13 + len(before)
        gold.append((kind, at, at + len(middle)) if kind else None)
    got = pii.added(tagger, texts, [{} for _ in texts], 4.0)
    hit = sum(g in s for s, g in zip(got, gold, strict=True) if g)
    false = sum(bool(s) for s, g in zip(got, gold, strict=True) if not g)
    assert hit >= 0.8 * sum(g is not None for g in gold) and false <= 0.1 * sum(g is None for g in gold)


def test_best_paths_are_those_of_an_exhaustive_decode(tagger):
    """Of every text, by the CRF's recursion over all of its characters, with every tag at every place."""
    rng = np.random.default_rng(3)
    words = "the and of to in at dot key token 4111 1111 10.0.0.1 jo@a.example.org x9f86d081884c7d 555-1234 +1 (613)".split()
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 9, 40, 200, 700)] + ["9f86d081" * 200, "jo.doe@" + "a" * 1500 + ".org"]
    trans = tagger.transitions()
    for text, got in zip(texts, tagger.spans([encode(t) for t in texts]), strict=True):
        if not text:
            assert got == []
            continue
        e = tagger.whole_emissions([encode(text)], np.zeros(1, np.int64), len(text) + 1)[:, : len(text)].T.astype(float)
        best, back = np.where(np.arange(tagger.tags) % 2 * 2 + (np.arange(tagger.tags) == 0) > 0, e[0], -1e9), []
        for t in range(1, len(text)):
            s = best[:, None] + trans
            back.append(s.argmax(axis=0))
            best = s.max(axis=0) + e[t]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        assert [x[:3] for x in got] == tag_spans(np.array(tags[::-1]))


def test_windows_are_stitched(tagger):
    """Emissions don't depend on which texts are read together, and spans may cross windows."""
    filler = "and so it went on for a while with nothing of note "
    long = "jo." + "x" * 900 + "@fields.example.org"
    texts = [filler * 12 + 'password: "9f86d081884c7d659a2feaa0c55ad015"' + filler * 30, filler, filler * 8 + long + " " + filler]
    alone = [tagger.spans([encode(t)])[0] for t in texts]
    assert [[x[:3] for x in own] for own in alone] == [[x[:3] for x in own] for own in tagger.spans([encode(t) for t in texts])]
    assert any(filler * 12 + 'password: "' == texts[0][:a] for _, a, _, _ in alone[0]) and not alone[1]
    # two windows and their contexts are read as one long window is
    text = encode(filler * 20)
    whole = tagger.emissions(text[:, None].astype(np.int64))[:, :, 0]
    assert np.abs(tagger.whole_emissions([text], np.zeros(1, np.int64), len(text) + 1)[:, : len(text)].T - whole).max() < 0.5


def test_gradients_are_those_of_differences():
    tagger = Tagger.new(2, size=5, hidden=4)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    codes, gold = rng.integers(97, 123, (3, 9)), rng.integers(0, 5, (3, 9))
    codes[0, -2:] = PAD
    _, grad = tagger.gradients(codes, gold)
    for k, p in tagger.p.items():
        i = (int(codes[1, 4]), 2) if k == "emb" else tuple(rng.integers(0, n) for n in p.shape)
        own, ends = p[i], []
        for step in (1e-4, -1e-4):
            p[i] = own + step
            ends.append(tagger.gradients(codes, gold)[0])
        p[i] = own
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(float(grad[k][i]), abs=2e-4)


def test_planted_variants_in_whole_documents(spark):
    """Precision and recall in documents of which each holds one spelled-out address, one key or nothing."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and length(text) between 300 and 4000").orderBy("doc_id").limit(300)
    rng = np.random.default_rng(8)
    rows, planted = [], {}
    for r in real.collect():
        cut = r.text.find(" ", len(r.text) // 2)
        if r.doc_id % 3 and cut > 0:
            word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
            new = f"{word(5)} dot {word(6)} at {word(7)} dot org" if r.doc_id % 3 == 1 else "".join(rng.choice(list("0123456789abcdef"), 40))
            lead = " " if r.doc_id % 3 == 1 else ' token = "'
            rows.append((r.doc_id, r.text[:cut] + lead + new + (" " if lead == " " else '" ') + r.text[cut:]))
            planted[r.doc_id] = (cut + len(lead), cut + len(lead) + len(new))
        else:
            rows.append((r.doc_id, r.text))
    found = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    right = wrong = 0
    for i, r in found.items():
        base = set(filter(None, pii.joined(_naive(texts[i])).split(",")))
        for x in set(filter(None, r.spans.split(","))) - base:
            a, b = map(int, x.split(":")[1:])
            true = (a, b) == planted.get(i) or re.fullmatch("[0-9a-fA-F]{40}", texts[i][a:b])
            right, wrong = right + bool(true and (a, b) == planted.get(i)), wrong + (not true)
    assert right >= 0.9 * len(planted) and wrong <= 0.05 * right


def test_masking(docs):
    out = by_id(pii.masked(docs.where("doc_id < 40 or doc_id is null"), steps=5))
    assert out[10].text.startswith("mail me: [EMAIL] or [PHONE] now") and out[0].text is None and out[10].fp == 1
    assert pii.redacted("abcdef", [("email", 1, 4), ("phone", 2, 5)], "[{}]") == "a[EMAIL]f"


# --- hashes and samples -------------------------------------------------------------------------------------------


def _complement_pair(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits[:n]), "".join("ba"[x] for x in bits[:n])


@pytest.mark.parametrize("n", [64, 256, 1024])
def test_words_whose_bytes_cancel_out_stay_apart(spark, n, tokenizer):
    a, b = _complement_pair(n)
    rows = [(1, f"{a} and so {a} it is"), (2, f"{b} and so {b} it is"), (3, f"{a} {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.ids_crc32 for r in repair_codec.round_trip(docs).collect()}
    want = {i: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows}
    assert found == want
    assert {r.doc_id: r.doc_tokens for r in cost_packing.packed(docs).collect()} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert all(r.component_id == r.doc_id for r in jaccard_join.jaccard_components(docs, k=2, percent=50).collect())
    counts = quality_forest.text_counts(pa.array([f"{a} x y\n{b} x y\n{a} x y"]))
    assert counts["n_distinct"].tolist() == [4] and counts["n_dup_lines"].tolist() == [1]


def test_samples_send_no_more_from_more_partitions(spark):
    df = spark.range(50_000).withColumn("hot", F.col("id") % 2)
    sizes = [len(thinned(df.repartition(n), 500, "id").collect()) for n in (4, 400)]
    assert sizes[0] == sizes[1] <= 1000
    assert hash_sample(df.repartition(40), 500, "id").count() == 500 and hash_sample(df, 500, "hot").count() <= 2
    assert {r.id for r in hash_sample(df.repartition(4), 50, "id").collect()} == {r.id for r in hash_sample(df.repartition(40), 50, "id").collect()}


# --- op3 and op8 ----------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_without_padding(docs, none, tokenizer):
    found = cost_packing.packed(docs, group=5000).collect()
    pieces, places = {}, {}
    for r in found:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        places.setdefault(r.sequence_id, []).append(r)
    for own in places.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    left = Counter()
    for t in docs.collect():
        ids = np.array([*tokenizer.encode(t.text or "", add_special_tokens=False).ids, 2], "<u4")
        left[t.doc_id, len(ids)] += len(ids)
        for r in pieces[t.doc_id, len(ids)]:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert left == Counter({k: sum(r.length for r in v) for k, v in pieces.items()})
    assert cost_packing.packed(none).count() == 0


def test_pack_balances_cost():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 3000).tolist() + [20_000]
    got = cost_packing.pack(lengths)
    used, cost = Counter(), Counter()
    for _, _, n, s, _ in got:
        used[s] += n
        cost[s] += cost_packing.cost(n)
    full = [cost[s] for s in used if used[s] == 4096]
    assert sum(used.values()) == sum(lengths) and np.quantile(full, 0.9) < 1.35 * np.median(full)
    assert len(got) < 1.2 * len(lengths)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for i in range(120):
        x = rng.integers(0, rng.integers(1, 6), rng.integers(0, 400)).astype(np.uint32)
        symbols, rules = repair_codec.compress(x, 10, 2)
        shard = repair_codec.Shard(np.arange(1), np.zeros(1, bool), np.array([len(x)], np.uint32), rules, repair_codec.expansion_lengths(rules).astype(np.uint32), symbols)
        shard = repair_codec.Shard.from_bytes(shard.to_bytes())
        a, b = sorted(rng.integers(0, len(x) + 1, 2))
        assert (shard.ids() == x).all() and (shard.ids(a, b) == x[a:b]).all() and (shard.document(0) == x).all()
        if len(rules):
            assert rules.max() < repair_codec.FIRST_NONTERMINAL + len(rules)
    x = np.tile(np.arange(50, dtype=np.uint32), 200)
    assert len(repair_codec.compress(x)[0]) < len(x) / 4
    with pytest.raises(ValueError):
        repair_codec.Shard.from_bytes(b"nope")


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    near = np.minimum(rng.integers(0, 300, (9000, 2)).min(axis=1), 299)
    inputs = [
        np.tile(rng.permutation(3000), 8),  # a long repeat: twelve rounds
        np.full(5000, 7), np.concatenate([np.full(n, 3) for n in range(2, 60)]), np.array([4, 4, 4, 4, 4, 4, 4]),  # runs of one id
        near, rng.permutation(np.repeat(np.arange(60), 2500)),
        np.tile(rng.integers(0, 60_000, 80_000), 6)[:400_000],  # more pairs than slots
    ]
    for x in (x.astype(np.uint32) for x in inputs):
        symbols, rules = repair_codec.compress(x)
        shard = repair_codec.Shard(np.arange(1), np.zeros(1, bool), np.array([len(x)], np.uint32), rules, repair_codec.expansion_lengths(rules).astype(np.uint32), symbols)
        assert (shard.ids() == x).all()
        pairs = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        assert len(pairs) == 0 or np.unique(pairs, return_counts=True)[1].max() < repair_codec.LEAST


def test_token_files(docs, none, tokenizer, monkeypatch):
    monkeypatch.setattr(repair_codec, "PART_ROWS", 4)
    files = repair_codec.encoded(docs, shard_ids=3000)
    assert files.count() > 4
    found = repair_codec.decoded(files).collect()
    ids = {}
    for t in docs.collect():
        own = np.array([*tokenizer.encode(t.text or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(t.doc_id, []).append((len(own), zlib.crc32(own.tobytes())))
    order = sorted(found, key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in order:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        at += r.n_tokens
    assert len(order) == docs.count() and repair_codec.round_trip(none).count() == 0


# --- op7 ------------------------------------------------------------------------------------------------------------


def test_language(docs, none, spark, data):
    found = byte_cnn.predicted(docs, sample=10, steps=5).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    blank = {r.doc_id for r in found if r.lang_pred == "und"}
    assert {0, 1, 2} <= blank and 3 not in blank
    assert byte_cnn.predicted(none).count() == 0
    assert {r.lang_pred for r in byte_cnn.predicted(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = byte_cnn.predicted(real, sample=150, steps=250).join(real, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.95


def test_no_window_is_left_out():
    data = np.arange(300, dtype=np.uint8)
    windows, row = byte_cnn.windows_of(data, np.array([0, 0, 128, 300]))
    assert row.tolist() == [1, 2, 2] and windows[0, :128].tolist() == list(range(128)) and windows[0, 128] == 256 and windows[2, 43] == data[299]


# --- op9 ------------------------------------------------------------------------------------------------------------


def test_rule_statistics(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    found = quality_forest.judged(docs, labels).collect()
    assert len(found) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in found:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeat = len({j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat)
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_forest.judged(none, labels).count() == 0
    assert {r.kept for r in quality_forest.judged(docs, labels.where("false")).collect() if not r.base_failed} <= {True}


def test_forests_single_out_junk_and_keep_clean_documents(spark):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_forest.judged(real, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] >= 0.99 and kept[0] <= 0.1


# --- op10 -----------------------------------------------------------------------------------------------------------


def _classes(rows, k, percent):
    sets = []
    for r in rows:
        w = WORD.findall((r.text or "").translate(LOWER))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and (100 * len(x & y) >= percent * len(x | y) or rows[i].doc_id == rows[j].doc_id is not None):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None and sets[i]:
            least[top(i)] = min(least.get(top(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), least.get(top(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_classes(docs, none, spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 8)  # lists are dealt out as pairs of blocks
    rng = np.random.default_rng(k)
    words = [f"w{i}" for i in range(60)]
    made = []
    for g in range(12):
        own = rng.choice(words, 40).tolist()
        for _ in range(12):
            copy = list(own)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = rng.choice(words)
            made.append((1000 + len(made), " ".join(copy)))
    more = spark.createDataFrame(made, "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more)
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(all_docs, k, percent).collect())
    assert found == _classes(all_docs.collect(), k, percent)
    assert jaccard_join.jaccard_components(none, k, percent).count() == 0


def test_list_pairs_skip_nothing_that_may_link():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(400, rng.integers(20, 60), replace=False).astype(np.uint64)) for _ in range(150)]
    sets += [np.sort(np.concatenate([s[1:], [np.uint64(500)]])) for s in sets[:40]]
    n = np.array([len(s) for s in sets])
    sketch = np.stack([np.frombuffer(jaccard_join.parity_sketch(s), np.uint64) for s in sets])
    at = np.arange(len(sets))
    i, j, _ = jaccard_join.list_pairs(at, n, np.zeros_like(n), at, np.full(len(at), 2), sketch, 80, block=16)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                assert (a, b) in got


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, "the cat sat on the mat and so on " * 5, "en") for i in range(20)] + [(100, "\u00bd \u00bd \u00b2 12", "en"), (101, "3 + 4 = 7 !", "en"), (102, "\u4f60\u597d", "en"), (103, "\u02b0", None)]
    got = {r.doc_id: r for r in byte_cnn.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=5).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (100, 101)] == [("und", 0.0)] * 2 and {got[i].lang_pred for i in (102, 103)} == {"en"}


def test_sets_that_share_a_name_are_named_anew(spark, monkeypatch):
    plain = jaccard_join.set_name
    monkeypatch.setattr(jaccard_join, "set_name", lambda h, seed=0: 5 if seed == 0 and len(h) else plain(h, seed))
    docs = spark.createDataFrame([(i, f"w{i} a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(8)] + [(20, "w1 a1 b1 c1 d1 e1 f1")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: i for i in range(8)} | {20: 1}


def test_frequent_shingles_are_chosen_by_count(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_MOST", 3)
    rows = [(None, [1, 2, 3, 4], [9, 9, 5, 1]), (None, [1, 5], [50, 3])]
    described = spark.createDataFrame(rows, "doc_id long, hot array<long>, times array<long>")
    tokens, times = jaccard_join._frequent(described)
    assert dict(zip(tokens.tolist(), times.tolist(), strict=True)) == {1: 59, 2: 9, 3: 5}


def test_added_addresses_have_their_parts():
    """No stretch of repeated words, no single word and nothing longer than an address can be is taken for one, whatever the tagger says."""
    fits = {"jane dot doe at site dot org": True, "bob (at) mail (dot) com": True, "bob at bob.com": True, "a.b @ c.org": True, "x@y.z": True, "der der der der der der": False, "Ating. Ating. Ating. Ating.": False, "ertionthed": False, "at noon": False, "a at b." + "c" * 250: False}
    assert {s: pii._possible("email", s, "") for s in fits} == fits


def test_long_base_spans_are_no_passages(spark):
    """An address of 100,000 characters is found, but not sent to the driver as a passage."""
    long = "a" * 100_000 + "@b.org"
    got = spark.createDataFrame([(0.1, long), (0.2, "mail x.y@z.org now")], "place double, text string").mapInArrow(pii._passages, "place double, number long, passage string, spans string").collect()
    assert pii.base_spans(long)["email"] == [(0, len(long))] and max(len(r.passage) for r in got) < 1000 and any(r.spans for r in got)
