import itertools
import random
import re
import sys
import unicodedata

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tallyline.functions import edit, rewrite, text
from tallyline.plans import suite_text


def apply(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_unicode_characters(spark):
    got = apply(spark, ["ＡＢ Ｃ!", "Straße", "x²", None, "今天，天气"], text.characters)
    assert got == ["abc", "strasse", "x2", "", "今天天气"]
    assert all(unicodedata.is_normalized("NFKC", g) for g in got)


def test_stable_characters_are_those_that_nfkc_never_changes():
    """None changes, moves past another or joins one before it."""
    stable, every = re.compile(f"[{text.STABLE}]"), list(map(chr, range(sys.maxunicode + 1)))
    parts = [d.split() for d in map(unicodedata.decomposition, every) if d and d[0] != "<"]
    joining = {chr(int(d[1], 16)) for d in parts if len(d) == 2} | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    for c in filter(stable.match, every):
        first = unicodedata.normalize("NFKD", c)[0]
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(first) and first not in joining, hex(ord(c))


def test_only_texts_that_nfkc_may_change_go_to_python(spark, monkeypatch):
    values = ["plain", "Äöü ßçñé", "今天 天气、カナ", "한국어", "Привет", "", None, "e\u0301", "ﬁ", "Ａ！", "a\xa0b", "\u1112\u1161\u11ab", "x²", "か\u3099", "\U0001f600", "q\u0307\u0323"]
    assert apply(spark, values, text.compatible) == [unicodedata.normalize("NFKC", v or "") for v in values]

    sent = F.arrow_udf("string")(lambda t: pc.if_else(pc.is_valid(t), "sent", None))
    monkeypatch.setattr(text, "_nfkc", sent)
    assert apply(spark, values[:9], text.compatible) == ["plain", "Äöü ßçñé", "今天 天气、カナ", "한국어", "Привет", "", "", "sent", "sent"]


def test_words_terms_and_buckets(spark):
    assert apply(spark, ["Don’t stop 今天 a1"], text.words) == [["don't", "stop", "今", "天", "a1"]]
    assert apply(spark, ["the cat", "scatter", "CAT!"], lambda c: text.contains_term(c, "cat")) == [True, False, True]
    assert apply(spark, ["我们今天", "明天"], lambda c: text.contains_term(c, "今天")) == [True, False]
    assert apply(spark, [20, 21, 40, 60, 61], text.length_bucket, "int") == ["1-20", "21-40", "21-40", "41-60", "61+"]
    assert apply(spark, [2.0, 4.0, 8.0, 16.0, 16.1, None, float("nan"), 0.0], text.duration_bucket, "double") == ["(0,2]", "(2,4]", "(4,8]", "(8,16]", "(16,+inf)", "unknown", "unknown", "unknown"]
    assert apply(spark, ["2026-01-03", "2026-1-3", "yesterday", None], text.iso_date) == [True, False, False, False]


def test_seed_is_the_first_eight_bytes(spark):
    import hashlib

    want = [(int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big") + 77) % 2**32 for s in ("a", "b7")]
    assert apply(spark, ["a", "b7"], lambda c: text.seed_of(c, 77)) == want


def test_alignments_of_all_short_strings(spark):
    strings = ["".join(s) for n in range(4) for s in itertools.product("ab", repeat=n)]
    pairs = [(r, h) for r in strings for h in strings]
    rows = spark.createDataFrame(pairs, "r string, h string").select("r", "h", edit.alignment("r", "h").alias("a"), edit.distance(F.col("h"), F.col("r")).alias("d"), edit.token_distance(F.split("h", ""), F.split("r", "")).alias("t")).collect()
    for x in rows:
        a = x.a
        assert a.substitutions + a.deletions + a.insertions == x.d and a.matches + a.substitutions + a.deletions == len(x.r) and a.matches + a.substitutions + a.insertions == len(x.h)
        assert len(a.ops) == x.d
        if x.r and x.h:
            assert x.t == x.d
    tie = next(x.a for x in rows if (x.r, x.h) == ("ab", "ba"))
    assert (tie.substitutions, tie.deletions, tie.insertions) == (2, 0, 0)


def test_alignments_of_long_texts(spark, monkeypatch):
    """Those of a whole table, also where columns are dealt into parts and these into parts; 8,000,000 cells and more, within memory that grows with the texts alone."""
    import tracemalloc

    def plain(r, h):
        table = [[i + j if not i or not j else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
        for i in range(1, len(r) + 1):
            for j in range(1, len(h) + 1):
                table[i][j] = min(table[i - 1][j - 1] + (r[i - 1] != h[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
        i, j, ops = len(r), len(h), []
        while i or j:
            if i and j and table[i][j] == table[i - 1][j - 1] + (r[i - 1] != h[j - 1]):
                i, j = i - 1, j - 1
                ops += [("substitution", r[i], h[j])] if r[i] != h[j] else []
            elif i and table[i][j] == table[i - 1][j] + 1:
                i -= 1
                ops.append(("deletion", r[i], ""))
            else:
                j -= 1
                ops.append(("insertion", "", h[j]))
        return ops[::-1]

    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abc我𠀀") for _ in range(n))
    pairs = [(some(rng.choice([0, 1, 9, 40, 90])), some(rng.choice([0, 1, 9, 40, 90]))) for _ in range(60)]
    for kept, parts in ((edit.KEPT, edit.PARTS), (0, 2), (60, 3)):
        monkeypatch.setattr(edit, "KEPT", kept)
        monkeypatch.setattr(edit, "PARTS", parts)
        assert [edit._aligned(r, h)["ops"] for r, h in pairs] == [plain(r, h) for r, h in pairs]
    monkeypatch.undo()
    base = some(3000)
    long = [(base, base[:1000] + "x" + base[1001:2500] + base[2501:] + "yz"), (some(2500), some(3500)), ("", some(5000)), (some(5000), None)]
    got = spark.createDataFrame(long, "r string, h string").select("r", "h", edit.alignment("r", "h").alias("a"), edit.distance(F.coalesce("h", F.lit("")), F.col("r")).alias("d")).collect()
    for x in got:
        assert x.a.substitutions + x.a.deletions + x.a.insertions == x.d == len(x.a.ops) and x.a.matches + x.a.substitutions + x.a.deletions == len(x.r)
    assert sorted(x.d for x in got)[0] == 4
    # columns of 8000 by 8000 take 16 MB as bits and 256 MB as numbers
    monkeypatch.setattr(edit, "KEPT", 1 << 20)
    r, h = some(8000), some(8000)
    tracemalloc.start()
    edit._aligned(r, h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20


def test_pieces_of_many_edits_end_early():
    """Rows of 60,000 edits each aren't all held as Python values."""
    import pyarrow as pa

    batch = (pa.array(["", "ab", ""] * 4), pa.array(["x" * 60_000, "ax", "y" * 60_000] * 4))
    got = list(edit.alignment.func(iter([batch])))
    assert [len(p) for p in got] == [3] * 4 and pa.concat_arrays(got).field("insertions").to_pylist() == [60_000, 0, 60_000] * 4


def test_numbers_and_cleanup(spark):
    got = apply(spark, ["it was nineteen forty three", "twenty twenty six or twenty six", "one two eleven films", "ten ten"], rewrite.numbers_to_digits)
    assert got == ["it was 1943", "2026 or 26", "one two 11 films", "1010"]
    got = apply(spark, ["what did i say", "i think i'm right", "done!", "", "今天天气很好", "今天？"], rewrite.basic_cleanup)
    assert got == ["What did I say?", "I think I'm right.", "Done!", "", "今天天气很好。", "今天？"]


def test_numbers_are_those_of_a_plain_reading(spark):
    """Word by word, by another way than the expression's; any white space stands between words."""
    units, teens, tens = rewrite.UNITS[1:], rewrite.TEENS, rewrite.TENS
    value = {w: i for i, w in enumerate(rewrite.UNITS + teens)} | {w: 10 * i for i, w in enumerate(tens, 2)}

    def two(w, i):
        """The value of a number of 10 to 99 at a place, and the place behind it."""
        if i < len(w) and w[i] in tens:
            return (value[w[i]] + value[w[i + 1]], i + 2) if i + 1 < len(w) and w[i + 1] in units else (value[w[i]], i + 1)
        return (value[w[i]], i + 1) if i < len(w) and w[i] in teens else None

    def read(t):
        w, out, i = (t or "").split(), [], 0
        while i < len(w):
            year = two(w, i + 1) if w[i] in teens or w[i] == "twenty" and not (i + 1 < len(w) and w[i + 1] in units) else None
            n, i = (100 * value[w[i]] + year[0], year[1]) if year else two(w, i) or (w[i], i + 1)
            out.append(str(n))
        return " ".join(out)

    rng = random.Random(3)
    pool = [*units, *teens, *tens, *["twenty"] * 8, "zero", "x", "twentyish", "sixth", "ten,", "今天", "$1", "\\\\"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", "\u3000", "\x1c", "\x85"]) for _ in range(rng.randrange(12))) for _ in range(600)]
    texts += [None, "", " ", "\n", "ten", " ten\n", "twenty sixth", "nineteen twenty six"]
    assert apply(spark, texts, rewrite.numbers_to_digits) == [read(t) for t in texts]


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_guards_take_one_step_in_python_and_numbers_none(spark, data):
    """Each step is a worker of its own for each core of an executor."""
    assert python_steps(suite_text.sc23(spark, data)) == 1
    assert [python_steps(q(spark, data)) for q in (suite_text.sc20, suite_text.sc21)] == [0, 0]


def test_guard(spark):
    cases = [
        ("i have twenty six dollars", "I have 26 dollars", ["i have twenty six dollars"], []), ("i have 26 dollars", "I have 27 dollars", [], ["numbers", "outside"]), ("do it", "do not it", [], ["negation", "outside"]),
        ("meet ann today", "meet bob tomorrow", [], ["units", "names", "large", "outside"]), ("hello", "", [], ["empty"]), ("same words", "Same words.", [], []),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i long, o string, p string, c array<string>")
    got = {r.i: r.w for r in df.select("i", rewrite.guard_warnings(F.col("o"), F.col("p"), F.col("c"), ["ann"]).alias("w")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_visemes_and_names(spark):
    assert apply(spark, ["HALE", "Miguel", "queen", "", "book"], rewrite.visemes) == ["AT", "MIKAT", "KWIT", "", "MUK"]
    snap = rewrite.name_snapper(["Miguel"], frozenset({"the", "plank", "nickel"}), frozenset({"my"}))
    assert apply(spark, ["ASK MCCALL my planks", "NICKEL"], snap) == ["ASK MIGUEL my planks", "NICKEL"]
    near = rewrite.name_snapper(["Bigelow"], frozenset({"the"}))
    assert apply(spark, ["the PIGELOW", "the"], near) == ["the BIGELOW", "the"]
    assert rewrite.is_word("stopped", {"stop"}) and rewrite.is_word("planks", {"plank"}) and not rewrite.is_word("mccall", {"call"})
    assert apply(spark, ["Hello Anna. anna met McGee and NASAX at Rome"], lambda c: rewrite.extracted_names(c, ["hello"])) == [["Anna", "McGee", "Rome"]]


def test_spans_lines_and_replies(spark):
    df = spark.createDataFrame([("abc def", "abc XY def"), ("aaa", "aaaa"), ("", "new"), ("same", "same"), ("ab", "ba")], "b string, a string")
    got = [r.s for r in df.select(rewrite.inserted_span(F.col("b"), F.col("a")).alias("s")).collect()]
    want = []
    for b, a in [("abc def", "abc XY def"), ("aaa", "aaaa"), ("", "new"), ("same", "same"), ("ab", "ba")]:
        p = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(b, a))))  # noqa: B905
        s = len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(reversed(b[p:]), reversed(a[p:])))))  # noqa: B905
        want.append(a[p : len(a) - s])
    assert got == want
    assert apply(spark, ["I have 2 cats. It's fine, really! ok"], rewrite.training_lines) == [["IT'S FINE REALLY"]]
    got = apply(spark, ['```json\n{"a": "x", "b": "y"}\n```', '{"a": "x"}', "no", '{"a": "x", "b": "y", "c": "z"}'], lambda c: rewrite.strict_reply(c, ["a", "b"]))
    assert [tuple(g) if g else None for g in got] == [("x", "y"), None, None, None]


@pytest.mark.parametrize(("raw", "want"), [("▁the▁cat<eos>", "the cat"), ("a<space>b   c", "a b c")])
def test_decoded(spark, raw, want):
    assert apply(spark, [raw], text.decoded) == [want]


def test_inserted_spans_of_long_texts(spark):
    """Linear in the text's length: against a plain loop, and on texts for which all places by all places would never end."""
    from pyspark.sql import functions as F

    from tallyline.functions import rewrite

    def plain(a, b):
        n = min(len(a), len(b))
        head = next((i for i in range(n) if a[i] != b[i]), n)
        tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
        return b[head : len(b) - tail]

    rows = [("", ""), ("", "a"), ("a", ""), ("aa", "aaa"), ("abab", "ab"), ("abc", "axc"), ("a我b", "a我𠀀b"), ("same", "same"), (None, "a"), ("xay", "xbby"), ("ab" * 30_000, "ab" * 20_000 + "XYZ" + "ab" * 10_000)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", rewrite.inserted_span(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r.a, r.b, r.s) for r in got] == [(a, b, plain(a or "", b)) for a, b in rows]


def test_few_rows_at_a_time_are_python_values():
    """A batch of any size is taken in pieces, so a worker never holds the edits or tokens of all its rows."""
    import pyarrow as pa

    from tallyline.functions import edit

    held = []
    a = pa.array(["ab"] * 1000)
    got = [held.append(len(p)) or p for p in edit.in_pieces(iter([(a, pa.array(["ax", None] * 500))]), lambda r, h: edit._aligned(r or "", h or ""), edit._ALIGNMENT)]
    assert max(held) == edit.PIECE and sum(held) == 1000
    assert pa.concat_arrays(got).field("substitutions").to_pylist() == [1, 0] * 500


def test_words_of_long_texts(spark):
    """Characters that become several cost as others do: a long text with ß and ligatures takes about as long as one without, and has the words of a plain loop."""
    import re
    import time
    import unicodedata

    from tallyline.functions import text

    def plain(t):
        folded = "".join(f if re.search("[a-z0-9']", f := unicodedata.normalize("NFKC", c).casefold()) else c for c in t).lower().replace("’", "'")
        return re.findall(r"[一-鿿]|[a-z0-9]+(?:'[a-z]+)?", folded)

    rows = ["Straße ß’s ﬁn's ﬁﬂ №5 ㎏ ² ẞA", "Ｗｉｄｅ don’t 我x ½ é", "", "ß", "ﬃ\nﬁ"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(text.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [plain(t) for t in rows]

    def seconds(t):
        df = spark.createDataFrame([(t,)], "t string").select(F.size(text.words(F.col("t"))).alias("n"))
        df.collect()
        begin = time.monotonic()
        assert df.first().n == len(plain(t))
        return time.monotonic() - begin

    base = "strasse und wege " * 120_000
    assert max(seconds("ß" + base), seconds(base + "ﬁ")) < 5 * seconds(base) + 2


def test_distances_of_long_texts(spark):
    """By bit vectors: those of the built-in function, null for null; texts of 20,000 characters in far less than a step for each of 400,000,000 pairs."""
    import random
    import time

    rng = random.Random(5)
    pairs = [("".join(rng.choice("abcé我𠀀") for _ in range(rng.randrange(150))), "".join(rng.choice("abcé我𠀀") for _ in range(rng.randrange(150)))) for _ in range(400)]
    pairs += [("", ""), ("", "a"), ("ab", ""), ("same", "same"), (None, "a"), ("a", None)]
    got = spark.createDataFrame(pairs, "a string, b string").select(edit.long_distance("a", "b").alias("x"), edit.distance(F.col("a"), F.col("b")).alias("y")).collect()
    assert all(r.x == r.y for r in got) and got[-1].x is None
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    begin = time.monotonic()
    assert edit._characters_apart(long, "x" + long[:10_000] + "yz" + long[10_001:]) == 3 and time.monotonic() - begin < 2
