import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyline.llm import fill_in_middle as fim
from tallyline.llm import queries


def naive(doc_id, text):
    """The contract's words, step by step."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(("7:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(lines), "plain", None, None, text
    n = len(lines)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_every_document_by_brute_force(docs):
    got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in fim.transformed(docs).collect()), key=str)
    want = sorted(((r.doc_id, naive(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    assert got == want and {f for _, (_, f, *_) in got} == {"plain", "psm", "spm"}


def test_query_gives_digests_of_outputs_and_texts(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(((r.doc_id, r.form, r.output_sha256, r.restored_sha256) for r in queries.queries()["op12_fill_in_middle"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((r.doc_id, (x := naive(r.doc_id, r.text))[1], sha(x[4]), sha(r.text or "")) for r in docs.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("text", ["a", "\n", "\n\n\n", "a\nb", "a\n\nb\n", "<\nP>\n<\nS>", "<P\n<S\n<M\n", "é\n你好\n😀\n", "x\r\ny\x85z w\n", "<P>", "a<S>b", "\n<M>\n"])
def test_texts_are_rebuilt(text):
    units, forms = fim.regex.compile(fim.LINES), set()
    for i in range(60):
        n, form, prefix, middle, output = fim.transformed_text(text, fim.draws(7, i), units, 100, 50)
        assert (n, form, prefix, middle, output) == naive(i, text) and fim.restored_text(output, form) == text
        forms.add(form)
    assert forms == ({"plain"} if any(m in text for m in ("<P>", "<S>", "<M>")) else {"psm", "spm"})


def test_rates_and_units(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit(1).alias("n"), F.lit("x").alias("form"), F.lit("y").alias("output"))
    rows = fim.transformed(docs, rate=30, spm=0, units=r"\S+\s*").collect()
    assert {r.n for r in rows} == {4} and {r.form for r in rows} == {"plain", "psm"} and 80 < sum(r.form == "psm" for r in rows) < 160
    assert {r.prefix_chars for r in rows} <= {None, 0, 4, 8, 14, 18}


def test_nothing_gives_nothing(none):
    assert fim.digests(fim.transformed(none)).collect() == []
