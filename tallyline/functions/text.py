"""Text columns: normalisation, tokens, buckets and transforms. Built-in functions where they exist, Arrow UDFs where not."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edit import in_pieces


def ascii_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits of a text: what is left of NFKC + casefold where accents are dropped."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def _characters(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


@F.arrow_udf(T.StringType())
def characters(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC, casefold, and only characters of the Unicode categories L and N. Python, as Spark has neither NFKC nor casefold."""
    yield from in_pieces(text, _characters, pa.string())


#: Delimiters that are no target units.
DELIMITERS = "，。！？；、：“”‘’（）【】《》,.!?;:\"'()[]"


#: Characters that NFKC leaves alone whatever stands beside them if that is of these too: Latin, Greek, Cyrillic, Han, kana, Hangul, common marks.
STABLE = (
    "\\x00-\\x9f\\xa1-\\xa7\\xa9\\xab-\\xae\\xb0\\xb1\\xb6\\xb7\\xbb\\xbf-\\xff\\u0100-\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u0391-\\u03a1\\u03a3-\\u03ce\\u0400-\\u0482\\u048a-\\u052f"
    "\\u2010\\u2012-\\u2016\\u2018-\\u2023\\u20ac\\u3001-\\u3029\\u3041-\\u3096\\u30a1-\\u30fe\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7a3"
)


@F.arrow_udf(T.StringType())
def _nfkc(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_pieces(text, lambda x: None if x is None else unicodedata.normalize("NFKC", x), pa.string())


def compatible(text: Column) -> Column:
    """NFKC, which Spark has no function for. Only texts with other characters than STABLE ones go to Python; ASCII is told apart first."""
    return F.coalesce(_nfkc(F.when(text.rlike(rf"[\x{{80}}-\x{{10ffff}}&&[^{STABLE}]]"), text)), text, F.lit(""))


#: Han characters as a part of a character class: for Python and for Spark's (Java's) expressions. SPACE is white space beyond ASCII, too.
HAN = "\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0002fa1f"
JAVA_HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{20000}-\x{2fa1f}"
SPACE = r"\s\x1c-\x1f"


def target_units(text: Column) -> Column:
    """The characters that a recogniser must produce: of the text in NFKC all but white space and delimiters."""
    kept = F.translate(F.regexp_replace(compatible(text), f"(?U)[{SPACE}]", ""), DELIMITERS, "")
    return F.filter(F.split(kept, ""), lambda c: c != "")


def compact(text: Column) -> Column:
    """The text in NFKC without white space and punctuation."""
    return bare(compatible(text))


def bare(text: Column) -> Column:
    """A text that is in NFKC already without white space and punctuation."""
    return F.regexp_replace(text, rf"(?U)[{SPACE}\p{{P}}]", "")


def _folding() -> tuple[str, str]:
    """Characters whose NFKC and casefold is another single ASCII letter, digit or Han character, and what that is."""
    pairs = {}
    for point in range(0x80, 0x30000):
        c = chr(point)
        folded = unicodedata.normalize("NFKC", c).casefold()
        if len(folded) == 1 and folded != c and (folded.isascii() and folded.isalnum() or "\u4e00" <= folded <= "\u9fff"):
            pairs[c] = folded
    return "".join(pairs), "".join(pairs.values())


def _several() -> dict[str, str]:
    """Characters whose NFKC and casefold is several, with a Latin letter, digit, apostrophe or Han character among them: ligatures, units, numbers in circles."""
    both = ((chr(p), unicodedata.normalize("NFKC", chr(p)).casefold()) for p in range(0x80, 0x30000))
    return {c: f for c, f in both if len(f) > 1 and any(x.isascii() and (x.isalnum() or x == "'") or "\u3400" <= x <= "\u9fff" for x in f)}


def _ranges(characters: list[str]) -> str:
    """A character class's inside."""
    out: list[list[int]] = []
    for p in sorted(map(ord, characters)):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_SEVERAL = _several()
_SEVERAL_CLASS = _ranges(list(_SEVERAL))
_FOLD_FROM, _FOLD_TO = _folding()
#: What folds otherwise than by lower case; ASCII is told apart first.
_FOLDS = rf"[\x{{80}}-\x{{2ffff}}&&[{_ranges([*_FOLD_FROM, *_SEVERAL])}]]"


def words(text: Column) -> Column:
    """Latin words (with inner apostrophes and digits) and single Han characters of the folded text.

    Folding is NFKC and casefold of each character that becomes Latin letters, digits or Han characters; built-in functions only. ß, which German
    texts are full of, is replaced; only texts with another such character are translated and, at the characters that become several, put together from a table."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss"))
    table = F.map_from_arrays(F.split(F.lit("\x00".join(_SEVERAL)), "\x00"), F.split(F.lit("\x00".join(_SEVERAL.values())), "\x00"))
    pieces = F.regexp_extract_all(F.translate(plain, _FOLD_FROM, _FOLD_TO), F.lit(rf"[^{_SEVERAL_CLASS}]++|[{_SEVERAL_CLASS}]"), F.lit(0))
    # the table is searched from its beginning, so only for single characters
    spread = F.array_join(F.transform(pieces, lambda c: F.when(F.length(c) > 1, c).otherwise(F.coalesce(F.try_element_at(table, c), c))), "")
    plain = F.replace(F.lower(F.when(plain.rlike(_FOLDS), spread).otherwise(plain)), F.lit("’"), F.lit("'"))
    return F.regexp_extract_all(plain, F.lit(rf"[a-z0-9]++(?:'[a-z]++)?+|[{JAVA_HAN}]"), F.lit(0))


def has_han(text: Column) -> Column:
    return text.rlike(f"[{JAVA_HAN}]")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 20, "1-20").when(n <= 40, "21-40").when(n <= 60, "41-60").otherwise("61+")


def duration_bucket(seconds: Column) -> Column:
    """Right-closed bins; unknown unless positive and finite."""
    known = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(seconds <= 2, "(0,2]").when(seconds <= 4, "(2,4]").when(seconds <= 8, "(4,8]").when(seconds <= 16, "(8,16]").otherwise("(16,+inf)")


def decoded(text: Column) -> Column:
    """A decoder's text: word marks to spaces, markers out, white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "▁|<space>", " "), "<eos>", ""), r"\s+", " "))


def contains_term(text: Column, term: str) -> Column:
    """Han terms as substrings, Latin ones as whole words, letter case aside."""
    if any("㐀" <= c <= "鿿" for c in term):
        return F.contains(F.lower(text), F.lit(term.lower()))
    quoted = "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in term)
    return text.rlike(rf"(?i)(?<!\w){quoted}(?!\w)")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def iso_date(text: Column) -> Column:
    """Whether the text is a date as it would be printed again; parsers alone accept 'yesterday' and 2026-1-3."""
    return F.coalesce(F.date_format(F.try_to_date(text), "yyyy-MM-dd") == text, F.lit(False))


def seed_of(sample_id: Column, seed: int) -> Column:
    """(first 8 bytes of sha256, big endian, + seed) modulo 2 ** 32."""
    first = F.conv(F.substring(F.sha2(sample_id, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(first + F.lit(seed), F.lit(4294967296)).cast("long")


def looks_spoken(text: Column) -> Column:
    """Natural language: 2 to 400 words, over 85 % letters or spaces, and neither JSON nor a path nor an address."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(n.between(2, 400) & (letters > 0.85) & ~text.rlike(r"^\s*(?:[\[{/]|http)"), F.lit(False))
