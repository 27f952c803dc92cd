"""Queries of choices, forms, guards and corrections. Turns stand in for recognised texts; Mandarin ones are the same turns with Han characters for letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wording
from .suite_text import turns

S, D = SparkSession, DataFrame

#: What the letters a to z become: common characters, so that texts have numbers, days, negations, people, questions, particles and fillers.
HAN_LETTERS = "我要今天的不去吗说话人这里地得嗯，。什么一三五你他会"


def mandarin(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", HAN_LETTERS), r"[^\x{3000}-\x{9fff}，。？!?]", "")


def _proposed(rows: D, proposals: dict[str, Column]) -> D:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), p.alias("proposed")) for n, p in proposals.items())))
    return rows.select("i", "raw", each.alias("x")).select("i", "raw", "x.*")


def sc24(spark: S, sf: str) -> D:
    raw = F.col("raw")
    rows = turns(spark, sf).select("i", mandarin(F.col("text")).alias("raw"))
    made = _proposed(rows, {
        "closed": wording.punctuated(raw), "asked": F.concat(raw, F.lit("？")), "particle": F.regexp_replace(raw, "^(.{6})", "$1得"), "shorter": F.substr(raw, F.lit(4)), "plain": wording.canonical_register(raw),
        "bare": wording.without_fillers(raw), "split": F.regexp_replace(raw, "今天|什么", "今，天"), "turned": F.reverse(raw)})
    return wording.mandarin_reasons(made, raw, F.col("proposed"), F.array(F.lit("人这")), "reasons").select("i", "kind", F.array_join("reasons", ",").alias("reasons"))


def sc25(spark: S, sf: str) -> D:
    raw = F.col("raw")
    rows = turns(spark, sf).select("i", F.when(F.col("i") % 3 == 0, F.concat(F.lit("Um, "), "text")).otherwise(F.col("text")).alias("raw"))
    made = _proposed(rows, {
        "closed": F.concat(raw, F.lit("!")), "asked": F.concat(raw, F.lit("?")), "upper": F.upper(raw), "bare": F.regexp_replace(raw, "^Um, ", ""), "shorter": F.regexp_replace(raw, r"^\S+\s", ""),
        "number": F.concat(raw, F.lit(" 7")), "not": F.regexp_replace(raw, " ", " not "), "turned": F.reverse(raw)})
    return wording.english_reasons(made, raw, F.col("proposed"), F.array(F.lit("Und der")), "reasons").select("i", "kind", F.array_join("reasons", ",").alias("reasons"))


def sc13(spark: S, sf: str) -> D:
    key = F.element_at(wording.recognition_keys(F.array("text")), 1)
    return turns(spark, sf).select("i", F.md5(key).alias("key_md5"), F.size(F.filter(F.split(key, "\x1f"), lambda t: t != "")).cast("long").alias("tokens"))


def srt09(spark: S, sf: str) -> D:
    t = F.col("text")
    made = F.array(F.lit(" ").cast("string"), F.lower(t), t, F.regexp_replace(t, "[.,]", " !"), F.lit(None).cast("string"), F.lit("..."), F.regexp_replace(t, "e", "o"), F.regexp_replace(t, "n", "m"), F.regexp_replace(t, "a", "u"))
    return wording.choices(turns(spark, sf), made, "choices", english=True).select("i", F.posexplode("choices").alias("place", "choice")).select("i", "place", F.md5("choice").alias("choice_md5"))


def sc22(spark: S, sf: str) -> D:
    t = F.col("text")
    guesses = F.array(t, F.concat(t, F.lit(" twenty six")))
    each = {"same": t, "more": F.concat(t, F.lit(" 26")), "other": F.concat(t, F.lit(" zebra")), "two": F.concat(t, F.lit(" 26 26"))}
    loose = [wording.within_guesses(o, guesses).alias(f"{n}_loose") for n, o in each.items()]
    return turns(spark, sf).select("i", *loose, wording.within_guesses(each["more"], guesses, strict=True).alias("strict"), wording.within_guesses(each["two"], guesses, most_edits=1).alias("edits"), wording.within_guesses(each["other"], guesses, known=F.array(F.lit("zebra"))).alias("known"))


def _forms(rows: D, english: bool) -> D:
    each = wording.fast_forms(rows, F.col("raw"), F.array().cast("array<string>"), "forms", english).select("i", F.explode("forms").alias("f")).select("i", "f.*")
    return each.select("i", "label", F.md5("text").alias("text_md5"), "changed", F.array_join("reasons", ",").alias("reasons"))


def sc26(spark: S, sf: str) -> D:
    raw = F.translate(mandarin(F.col("text")), "说", "啥")
    return _forms(turns(spark, sf).select("i", raw.alias("raw")), False)


def sc27(spark: S, sf: str) -> D:
    return _forms(turns(spark, sf).select("i", F.when(F.col("i") % 2 == 0, F.concat(F.lit("uh, "), "text")).otherwise(F.col("text")).alias("raw")), True)


def sc34(spark: S, sf: str) -> D:
    """A turn whose 4th word was changed, with words typed before and after; likewise a Han text of which one character was."""
    t, han = F.col("text"), mandarin(F.col("text"))
    span = F.concat(F.lit("Well then. "), F.regexp_replace(t, r"^((?:\S+\s+){3})\S+", "$1corrected"), F.lit(" And some more words."))
    spans = F.array(F.struct(t.alias("pasted"), span.alias("span")), F.struct(han.alias("pasted"), F.concat(F.lit("好"), F.regexp_replace(han, "^(.{3}).", "$1好"), F.lit("好好")).alias("span")))
    return turns(spark, sf).select("i", F.posexplode(spans).alias("way", "x")).select("i", "way", F.md5(wording.correction("x.pasted", "x.span")).alias("fixed_md5"))


_KEY = r"""regexp_extract_all(lower(nfc_normalize(replace(replace(replace({t}, '’', ''''), '‘', ''''), 'ʼ', ''''))), '[\x{3400}-\x{9fff}]|\d+(?:[.,:/-]\d+)*|\p{L}[\p{L}\p{N}_]*(?:[''-][\p{L}\p{N}_]+)*|[^\s.,!?;:"''“”‘’()\[\]{{}}…，。！？；：、「」『』]')"""
_KEY_OF = lambda t: _KEY.replace("{t}", t).replace("{{", "{").replace("}}", "}")
_T = "WITH t AS (SELECT conv_id * 1000 + turn AS i, text FROM conversations)"

QUERIES = {
    "sc13_recognition_keys": (sc13, _T + f" SELECT i, md5(array_to_string({_KEY_OF('text')}, chr(31))) AS key_md5, len({_KEY_OF('text')}) AS tokens FROM t"),
    "sc22_within_guesses": (sc22, None),
    "sc24_mandarin_guard": (sc24, None),
    "sc25_english_guard": (sc25, None),
    "sc26_mandarin_forms": (sc26, None),
    "sc27_english_forms": (sc27, None),
    "sc34_corrections": (sc34, None),
    "srt09_choices": (srt09, _T + ", c AS (SELECT i, unnest([' ', lower(text), text, regexp_replace(text, '[.,]', ' !', 'g'), NULL, '...', replace(text, 'e', 'o'), replace(text, 'n', 'm'), replace(text, 'a', 'u')]) AS c, unnest(range(9)) AS p FROM t), k AS (SELECT i, p, c, array_to_string(" + _KEY_OF("c") + ", chr(31)) AS k FROM c WHERE c IS NOT NULL), f AS (SELECT i, min(p) AS p, arg_min(c, p) AS c FROM k WHERE k <> '' GROUP BY i, k), r AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY p) - 1 AS place, c FROM f) SELECT i, CAST(place AS INTEGER) AS place, md5(regexp_replace(regexp_replace(c, '^\\s+', ''), '\\s+$', '')) AS choice_md5 FROM r WHERE place < 3"),
}
