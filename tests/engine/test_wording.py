import pytest
from pyspark.sql import functions as F

from tallyline.functions import text, wording
from tallyline.operators import candidates, checks, conflicts, reranking
from tallyline.sources import readers

#: One reason each, by itself; None: the rewrite stands.
MANDARIN = [
    ("今天我去北京", "今天我去北京。", [], None), ("咋办啊", "怎么办啊。", [], None), ("嗯，我去", "我去", [], None), ("红花开", "红的花开", [], None), ("你去吗", "你去吗？", [], None), (None, "好", [], "content"),
    ("好", " 　", [], "empty"), ("好", None, [], "empty"), ("好", "好" * 41, [], "long"), ("好" * 250, "好" * 265, [], "long"),
    ("有3.5本", "有35本", [], "numbers"), ("涨5%", "涨5", [], "time"), ("不要去", "不，要去", [], "negation"), ("我们去", "我，们去", [], "roles"), ("不一定去", "不，一定去", [], "modality"),
    ("见张三丰", "见张，三丰", ["张三丰"], "names"), ("用Ｊａｖａ写", "用Ｊａ，ｖａ写", [], "latin"), ("好书", "好书？", [], "question"), ("去北京", "去上京", [], "content"), ("见李雷好书", "见李雷的好书", ["李雷"], "near_name"),
    ("红花开", "红的花地开", [], "particles"), ("“李雷”好书", "“李雷”的好书", [], "near_name"), ("我叫韩梅。好书", "我叫韩梅。好的书", [], "near_name"), ("啥时去", "咋时去", [], "content"),
]
ENGLISH = [
    ("um, we go", "We go.", [], None), ("see the api", "See the api!", [], None), ("don’t go", "Don't go.", [], None), ("", "x", [], "content"), ("go", "", [], "empty"), ("go", "g" * 41, [], "long"),
    ("a3,4 is", "a3 4 is", [], "numbers"), ("ask Sam Lee now", "ask Sam, Lee now", ["Sam Lee"], "names"), ("we go", "we go?", [], "question"), ("we go", "go we", [], "content"), ("we umm go", "we go", [], "content"),
    ("use the API now", "use the api now", [], "names"), ("USE THE API", "use the api", [], None), ("see x.org now", "see X.org now", [], "names"), ("use iPhone", "use iphone", [], "names"), ("we go", "we never go", [], "negation,content"),
]


@pytest.mark.parametrize("cases, guard", [(MANDARIN, wording.mandarin_reasons), (ENGLISH, wording.english_reasons)])
def test_guards(spark, cases, guard):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, raw string, made string, names array<string>, want string")
    got = guard(df, F.col("raw"), F.col("made"), F.when(F.size("names") > 0, F.col("names")), "found")
    assert got.columns == [*df.columns, "found"]
    assert [(r.raw, r.made, ",".join(r.found)) for r in got.orderBy("i").collect()] == [(a, b, w or "") for a, b, _, w in cases]


def test_forms(spark):
    rows = ["嗯，咋办。", "你去吗", " \n", None, "all latin", "咋" * 241, "什么，嗯，，好"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    got = {r.i: [(f.label, f.text, f.changed) for f in r.forms] for r in wording.fast_forms(df, F.col("t"), F.array().cast("array<string>"), "forms").collect()}
    assert got[0] == [("first", "嗯，咋办。", False), ("natural", "嗯，怎么办。", True), ("concise", "咋办。", True)]
    assert got[1] == [(n, "你去吗？", False) for n in ("first", "natural", "concise")]
    assert got[2] == got[3] == [] and got[4] == [("first", "all latin", False)] and {f[1] for f in got[5]} == {"咋" * 241 + "。"}
    assert got[6][2] == ("concise", "什么，好。", True)
    df = spark.createDataFrame(list(enumerate(["um, I see", "see, uh, him!", "你 too", "x" * 300])), "i int, t string")
    got = {r.i: [f.text for f in r.forms] for r in wording.fast_forms(df, F.col("t"), F.array().cast("array<string>"), "forms", english=True).collect()}
    assert got == {0: ["um, I see", "um, I see.", "I see."], 1: ["see, uh, him!", "see, uh, him!", "see, him!"], 2: ["你 too"], 3: ["x" * 300] * 3}


def test_choices_and_keys(spark):
    df = spark.createDataFrame([(1, ["It’s 3.5, OK", "it's 3.5 ok!", None, " ", "...", "its 35 OK", "你 好", "你好", "x"]), (2, []), (3, None)], "i int, c array<string>")
    assert {r.i: r.o for r in wording.choices(df, F.col("c"), "o").collect()} == {1: ["It’s 3.5, OK", "its 35 OK", "你 好。"], 2: [], 3: None}
    assert wording.choices(df.where("i = 1"), F.col("c"), "o", english=True).first().o == ["It’s 3.5, OK", "its 35 OK", "你 好"]
    keys = {"Don’t-go a_b 1:30": "don't-go|a_b|1:30", "中文abc": "中|文|abc", "«x»": "«|x|»", "": "", "É É": "é|é"}
    assert {k: wording._key(k).replace("\x1f", "|") for k in keys} == keys


def test_within_guesses(spark):
    df = spark.createDataFrame([("we have 26 cats", ["we have twenty six cats", "he has dogs"]), ("we have dogs", ["we have twenty six cats", "he has dogs"]), ("we own cats", ["we have cats"]), ("", ["a"]), ("", []), ("a", None)], "o string, c array<string>")
    o, c = F.col("o"), F.col("c")
    got = df.select(wording.within_guesses(o, c), wording.within_guesses(o, c, strict=True), wording.within_guesses(o, c, most_edits=1), wording.within_guesses(o, c, known=F.array(F.lit("own")))).collect()
    assert [tuple(r)[:4] for r in got[:5]] == [(True, True, True, True), (True, False, False, True), (False, False, False, True), (False, False, False, False), (False, True, False, False)]
    assert not any(got[5])


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_han_corrections_by_brute_force(spark):
    import random

    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("天地人你我") for _ in range(n))
    rows = [(word(rng.randint(1, 8)), word(rng.randint(0, 40))) for _ in range(150)]
    rows += [(p, word(3) + p + word(2)) for p, _ in rows[:10]] + [(None, "你"), ("你好", None), ("你好", ""), ("你好abc", "你坏 abc。")]
    want = []
    for p, s in rows:
        a, b = wording.tokens(p or ""), wording.tokens(s or "")
        most = max(2, int(len(a) * 0.4))
        every = [(apart(a, b[x : x + n]), abs(n - len(a)), x, b[x : x + n]) for x in range(min(len(b), 30)) for n in range(max(1, len(a) - 2), min(len(b) - x, len(a) + 2) + 1)] if a and len(b) >= max(1, len(a) - 2) else []
        best = min((e for e in every if e[0] <= most), default=None)
        want.append("".join(best[3]) if best and best[0] else None)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, s string")
    assert [r.f for r in df.select("i", wording.correction("p", "s").alias("f")).orderBy("i").collect()] == want and sum(w is not None for w in want) > 20


def test_han_corrections_of_long_texts():
    """Few edits, many or too many: those of brute force; texts of 2,000 characters without a step for each character and each start."""
    import random
    import time

    rng = random.Random(2)
    some = lambda n: [rng.choice("天地人你我") for _ in range(n)]
    kinds = set()
    for n in [9, 12, 20, 26] * 10:
        a = some(n)
        b = some(rng.choice([0, 3, 20])) + [rng.choice("天地人你我好") if rng.random() < rng.choice([0.05, 0.3, 0.8]) else c for c in a if rng.random() < 0.95] + some(rng.choice([0, 4]))
        most = int(n * 0.4)
        every = [(apart(a, b[x : x + k]), abs(k - n), x, k) for x in range(min(len(b), 30)) for k in range(n - 2, min(len(b) - x, n + 2) + 1)]
        best = min((e for e in every if e[0] <= most), default=None)
        assert wording._han_correction(a, b) == ("".join(b[best[2] : best[2] + best[3]]) if best and best[0] else None)
        assert sorted(wording._all_windows(a, b)) == sorted(every)
        kinds.add("none" if best is None else "few" if best[0] < 3 else "many")
    assert kinds == {"none", "few", "many"}
    begin = time.monotonic()
    for _ in range(150):
        a = some(2000)
        b = some(9) + a[:700] + ["好"] + a[701:] + some(9)
        assert wording._han_correction(a, b) == "".join(b[9:2009])
    assert all(wording._han_correction(some(2000), list("上下左右中") * 400) is None for _ in range(3))
    assert time.monotonic() - begin < 6


def test_word_corrections(spark):
    cases = [
        ("send it to jon today", "Hi. send it to John today. Thanks a lot", "send it to John today."), ("send it to jon", "send it to jon", None), ("send it to jon", "Send it, to Jon!", None), ("go home", "entirely other words here", None),
        ("see you at school", "see you at tool. Also can you come and bring the book", "see you at tool."), ("see you", "", None), ("see you", None, None), (None, "see you", None), ("one two three four five", "one 2 3 4 five", None),
        ("cat sat down here", "well then my own dog sat down here", "dog sat down here"), ("don’t go", "don't stay", "don't stay"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, p string, s string")
    assert [r.f for r in df.select("i", wording.correction("p", "s").alias("f")).orderBy("i").collect()] == [w for *_, w in cases]


def test_opcodes(spark):
    df = spark.createDataFrame([(list("qabxcd"), list("abycdf")), ([], list("a")), (None, [])], "a array<string>, b array<string>")
    got = [r.o and [tuple(e) for e in r.o] for r in df.select(wording.opcodes("a", "b").alias("o")).collect()]
    assert got == [[("delete", 0, 1, 0, 0), ("equal", 1, 3, 0, 2), ("replace", 3, 4, 2, 3), ("equal", 4, 6, 3, 5), ("insert", 6, 6, 5, 6)], [("insert", 0, 0, 0, 1)], None]


def test_folded_words(spark):
    cases = {"Ⅷ ㎏ ℡ ⑩ ﬁn Straße": "viii kg tel 10 fin strasse", "㍿ ㈠": "株 式 会 社 一", "㐀𠀀": "㐀 𠀀", "Don’t we'll'x": "don't we'll x", "Ａ１": "a1", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: " ".join(r.w) for r in df.select("t", text.words(F.col("t")).alias("w")).collect()} == cases
    assert df.select(text.words(F.lit(None).cast("string")).alias("w")).first().w == []
    df = spark.createDataFrame([("你　好 a\x85b。…", "你好ab")], "t string, want string")
    assert [tuple(r) for r in df.select(text.compact(F.col("t")) == F.col("want"), F.array_join(text.target_units(F.col("t")), "")).collect()] == [(True, "你好ab")]


def test_disagreement_counts_punctuation(spark):
    rows = [(1, 0, "。"), (1, 1, "abc"), (2, 0, " "), (2, 1, None), (3, 0, "ＡＢＣ"), (3, 1, "A B,C"), (4, 0, "abc"), (4, 1, "　"), (4, 2, "xyz")]
    got = checks.disagreement(spark.createDataFrame(rows, "sample_id int, rank int, t string"), F.col("t")).collect()
    assert {r.sample_id: r.disagree for r in got} == {1: True, 2: False, 3: False, 4: True}


def test_protocols_siblings_and_pixels(spark):
    rows = [(1, "val", 0.1, 4, 2, True, "x", 0.0), (2, "validation", 0.2, 4, 2, None, "x", 1.0), (3, "dev", 0.3, 4, 2, True, "", 1.5), (4, "test", 0.4, 4, 2, True, "x", None)]
    df = spark.createDataFrame(rows, "id int, split string, weight double, beam int, nbest int, label_verified boolean, label_source string, reverse_weight double")
    assert sorted(map(tuple, conflicts.protocol_issues(df).collect())) == [(2, "label"), (3, "label"), (3, "reverse weight"), (4, "reverse weight"), (4, "split")]
    take = "id int, speaker string, session string, date string, reference string, split string"
    new = spark.createDataFrame([(1, "a", "s", "d", "Ｈｉ.", "dev"), (2, None, "s", "d", "other", "dev")], take)
    old = spark.createDataFrame([(9, "b", "s", "d", "hi", "train"), (8, None, "s", "e", "x", "train")], take)
    assert [tuple(r) for r in conflicts.sibling_conflicts(new, old).collect()] == [(1, "reference")]
    shape = "id int, original string, shape int, seed int, preset string, output string, failed boolean"
    a = spark.createDataFrame([(1, "o", 1, 1, "p", "x", False), (2, "o", 1, 1, "p", None, False), (3, "o", 1, 1, "p", "x", None), (4, "o", 1, 1, "p", None, True)], shape)
    b = spark.createDataFrame([(1, "o", 1, 1, "q", "y", False), (2, "o", 1, 1, "p", "x", False), (3, "o", 1, 1, "p", "x", False), (4, "o", 1, 1, "p", "x", False)], shape)
    assert dict(map(tuple, conflicts.paired_pixels(a, b).collect())) == {1: "preprocessing", 2: "unknown", 3: "unknown", 4: "failed"}


def test_columns_of_many_nulls_are_found(spark):
    rows = [(None, f"some spoken words of row {i}" if i > 400 else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "empty string, `odd.name` string, n int").repartition(3)
    got = [tuple(r) for r in readers.text_columns(df).collect()]
    assert got == [] or got[0][0] == "odd.name"
    words = df.select(F.when(F.col("n") > 400, F.lit("just some spoken words here")).alias("asr_raw"), F.lit("these are words as well").alias("formatted"), "n")
    assert [(r.column, r["values"], r.filled) for r in readers.text_columns(words).collect()] == [("formatted", 300, 1000), ("asr_raw", 300, 599)]
    assert readers.text_columns(df.select("n")).collect() == []


def test_suggested_names_and_ties(spark):
    lines = ["we met Anna and NASA", "Anna met Bob-X and I'm Anna", "then Anna bob-x Bob-X Bob-X", "I saw Zed Zed Zed zed zed zed", "a Zoe Zoe Zoe"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    assert sorted(map(tuple, reranking.suggested_names(df, "i", "t", ["zoe"]).collect())) == [("Anna", 3, 0), ("Bob-X", 3, 1)]
    assert [r.word for r in reranking.suggested_names(df, "i", "t", [], most=2).collect()] == ["Anna", "Bob-X"]
    ops = spark.createDataFrame([(2, [("deletion", "z", "")] * 2), (1, [("deletion", "y", ""), ("deletion", "x", "")]), (3, [("deletion", "x", ""), ("deletion", "y", "")])], "k int, ops array<struct<op:string,ref:string,hyp:string>>").select("k", F.struct("ops").alias("alignment"))
    assert [r.ref for r in candidates.error_operations(ops, "k").orderBy("place").collect()] == ["y", "x", "z"]
