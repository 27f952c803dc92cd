"""Choices, forms and corrections of recognised text, and guards of proposed rewrites.

What compares two texts word by word, or character by character, goes through one Arrow UDF, ``opcodes``: the longest common block, then the same to
its left and its right, as an array of edits. Guards, choices and forms take
a frame and add columns, as what an Arrow UDF gives must be a column before a condition on its elements can read it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .edit import in_pieces, token_distance
from .rewrite import numbers_to_digits, same_bag
from .text import HAN, bare, words

# Patterns of what a rewrite must keep, pairs of plain and colloquial words, fillers, closing marks, sizes.
NUMBER = r"\d+(?:[.,:/-]\d+)*|[零〇一二两三四五六七八九十百千万亿]+"
TIME = (
    r"大后天|大前天|今天|明天|昨天|后天|前天|今年|明年|去年|本周|这周|下周|上周|星期[一二三四五六日天]|周[一二三四五六日天]|上午|下午|中午|晚上|早上|凌晨|"
    r"年|月|日|号|点|时|分|秒|元|块|美元|人民币|百分之|[$€£¥￥%]"
)
NEGATION = "不要|不能|不用|没有|不是|不会|不再|从未|并非|禁止|拒绝|不|没|勿|未|无|别"
ROLE = "我们|你们|他们|她们|它们|自己|我|你|他|她|它"
MODAL = "不一定|一定|必须|应该|可以|可能|已经|正在|将要|想要|所有|全部|一些|每个|只要|只|都|也|才|再|要|想|会|吗|呢|吧|着|了|过"
LATIN = "[A-Za-z][A-Za-z0-9_-]*"
QUOTED = "[“\"「『]([^”\"」』]+)[”\"」』]"
NAMED = r"(?:我叫|他叫|她叫|姓名是|名叫)([\x{3400}-\x{9fff}]{2,4})(?=[，。！？\s]|$)"
REGISTER = {"啥": "什么", "咋": "怎么", "这儿": "这里", "那儿": "那里"}
PARTICLES = "的地得"
HAN_FILLER = r"(?U)(^|[，,。；;！？!?\s])(?:嗯+|呃+)(?=[，,。；;！？!?\s]|$)"
EN_NUMBER = r"\d+(?:[.,:/-]\d+)*"
EN_NEGATION = r"(?U)\b(?:no|not|never|neither|nor|without|cannot|\w+n't)\b"
EN_LITERAL = r"https?://[^\s]+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\b[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+\b"
EN_FILLER = r"(?i)(?:^|(?<=[,;.!?]))\s*(?:um+|uh+)\s*(?=[,;.!?]|$)"
EN_TOKEN = r"(?=\w*(?:[^\W\d_]|_))\w+(?:['’_-]\w+)*|\d+(?:[.,:/-]\d+)*|[^\w\s.,!?;:\"“”‘’()\[\]{}…]"
KEY_TOKEN = r"[㐀-鿿]|\d+(?:[.,:/-]\d+)*|[^\W\d_㐀-鿿][^\W㐀-鿿]*(?:['-][^\W㐀-鿿]+)*|[^\s.,!?;:\"'“”‘’()\[\]{}…，。！？；：、「」『』]"
CLOSING, ASKING = "。！？.!?…", "吗|么|呢"
MOST_INPUT, MOST_MORE, LEAST_LIMIT = 240, 24, 40

_BLANK = r"(?U)^[\s\x1c-\x1f]*$"
_HAN = r"[\x{3400}-\x{9fff}]"
_EDIT = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in "ijkl")]))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _kept_apart(udf):  # noqa: ANN001, ANN202
    """The same function, called not deterministic: so the optimiser doesn't copy its call into a condition on elements, where it can't be run."""
    return udf.asNondeterministic()


@_kept_apart
@F.arrow_udf(T.StringType())
def _nfkc(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_pieces(text, lambda t: unicodedata.normalize("NFKC", t or ""), pa.string())


@_kept_apart
@F.arrow_udf(_EDIT)
def opcodes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """How array a becomes array b: (op, i, j, k, l) with op equal, replace, delete or insert over a[i:j] and b[k:l]; null if either is null."""
    one = lambda x, y: None if x is None or y is None else [dict(zip(("op", *"ijkl"), e, strict=True)) for e in SequenceMatcher(None, x, y, autojunk=False).get_opcodes()]
    yield from in_pieces(batches, one, pa.list_(pa.struct([("op", pa.string()), *((c, pa.int32()) for c in "ijkl")])))


# --- keys and choices ---------------------------------------------------------------------------------------------


def _key(text: str) -> str:
    """Tokens of a text in one string: letter case, sentence punctuation and spaces don't count, apostrophes and numeric separators do."""
    plain = re.sub("[’‘ʼ]", "'", unicodedata.normalize("NFC", text).lower())
    return "\x1f".join(re.findall(KEY_TOKEN, plain))


@_kept_apart
@F.arrow_udf(T.ArrayType(T.StringType()))
def recognition_keys(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The key of each text of an array; null texts have an empty one."""
    yield from in_pieces(texts, lambda all_: None if all_ is None else [_key(t or "") for t in all_], pa.list_(pa.string()))


def punctuated(text: Column) -> Column:
    """Han text with a closing mark: ？ after a word that asks, else 。; other text as it is."""
    t = stripped(text)
    mark = F.when(t.rlike(f"[{CLOSING}]$"), "").when(t.rlike(f"(?:{ASKING})$"), "？").otherwise("。")
    return F.when(t.rlike(_HAN), F.concat(t, mark)).otherwise(t)


def _steps(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Columns one after another; those that begin with an underscore are for later steps alone."""
    for step in steps:
        df = df.withColumns(step)
    return df


def choices(df: DataFrame, candidates: Column, out: str, english: bool = False, most: int = 3) -> DataFrame:
    """Adds an array: the first ``most`` candidates of different keys, in order, as shown; null and blank ones and those without a key are passed over."""
    df = _steps(df, {"_texts": candidates}, {"_keys": recognition_keys("_texts")})
    pairs = F.arrays_zip(F.col("_texts").alias("text"), F.col("_keys").alias("key"))
    first = F.filter(pairs, lambda p, i: (p["key"] != "") & (F.array_position(F.col("_keys"), p["key"]) == i + 1))
    shown = F.transform(first, lambda p: stripped(p["text"]) if english else punctuated(p["text"]))
    return df.withColumn(out, F.slice(shown, 1, most)).drop("_texts", "_keys")


def within_guesses(out: Column, candidates: Column, strict: bool = False, known: Column | None = None, most_edits: int | None = None) -> Column:
    """Whether a rewrite only uses words of the guesses (or ``known`` ones: an array). strict: just the words of the first guess.

    No words, or no candidates: false, but for a strict comparison of nothing with nothing."""
    # one call for all candidates: a mark between them, which is no word and ends a spoken number
    plain = lambda t: words(numbers_to_digits(F.lower(t)))
    said, top = plain(out), plain(F.coalesce(F.try_element_at(candidates, F.lit(1)), F.lit("")))
    if strict:
        return said == top
    pool = plain(F.array_join(candidates, " ␞ ", ""))
    pool = pool if known is None else F.concat(pool, known)
    inside = (F.size(said) > 0) & (F.size(F.array_except(said, pool)) == 0)
    return inside if most_edits is None else inside & (token_distance(said, top) <= most_edits)


# --- guards -------------------------------------------------------------------------------------------------------


def _count(text: Column, name: Column) -> Column:
    """How often a name stands in a text."""
    return F.when(F.length(name) > 0, (F.length(text) - F.length(F.replace(text, name, F.lit("")))) / F.length(name)).otherwise(0)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _size(raw: Column, proposed: Column) -> Column:
    """empty or long, of which no more is said; null if neither."""
    n = F.length(proposed)
    too_long = (n > F.greatest(F.length(raw) + MOST_MORE, F.lit(LEAST_LIMIT))) | (n > MOST_INPUT + MOST_MORE)
    return F.when(F.coalesce(proposed.rlike(_BLANK), F.lit(True)), "empty").when(too_long, "long")


def _asks(text: Column) -> Column:
    return text.rlike("[?？]")


def _reasons(size: Column, found: list[Column]) -> Column:
    return F.when(size.isNotNull(), F.array(size)).otherwise(F.array_distinct(F.array_compact(F.array(*found))))


def canonical_register(text: Column) -> Column:
    for colloquial, plain in REGISTER.items():
        text = F.replace(text, F.lit(colloquial), F.lit(plain))
    return text


def without_fillers(text: Column) -> Column:
    return F.regexp_replace(text, HAN_FILLER, "$1")


def protected_names(raw: Column, names: Column) -> Column:
    """Names given, quoted, introduced, and Latin words."""
    return F.array_distinct(F.filter(F.concat(names, _all(raw, QUOTED, 1), _all(raw, NAMED, 1), _all(raw, LATIN)), lambda n: n != ""))


@_kept_apart
@F.arrow_udf(T.ArrayType(T.StringType()))
def _compact_names(names: Iterator[pa.Array]) -> Iterator[pa.Array]:
    one = lambda n: "".join(c for c in unicodedata.normalize("NFKC", n) if not c.isspace() and unicodedata.category(c)[0] != "P")
    yield from in_pieces(names, lambda all_: None if all_ is None else [one(n) for n in all_], pa.list_(pa.string()))


def _given(raw: Column, proposed: Column, names: Column) -> tuple[dict[str, Column], ...]:
    return {"_raw": F.coalesce(raw, F.lit("")), "_made": F.coalesce(proposed, F.lit("")), "_names": F.coalesce(names, F.array().cast("array<string>"))}, {"_size": _size(F.col("_raw"), F.col("_made"))}


def mandarin_reasons(df: DataFrame, raw: Column, proposed: Column, names: Column, out: str) -> DataFrame:
    """Adds an array: why a rewrite of a Mandarin text can't stand (empty if it can).

    empty or long alone; numbers, time, negation, roles, modality (bags differ); names, latin; question; content (anything but a
    few added particles and what ``without_fillers`` and the register change), near_name (a particle within 4 characters of a name), particles
    (more than a twelfth of the text, 1 at least, 2 at most). A null text is an empty one."""
    plain = lambda t: canonical_register(bare(without_fillers(t)))
    letters = lambda t: F.when(F.col("_size").isNull(), F.filter(F.split(t, ""), lambda c: c != ""))
    col = F.col
    df = _steps(
        df, *_given(raw, proposed, names), {"_a": _nfkc("_raw"), "_b": _nfkc("_made"), "_kept": protected_names(col("_raw"), col("_names"))}, {"_left": plain(col("_a")), "_right": plain(col("_b"))},
        {"_edits": opcodes(letters(col("_left")), letters(col("_right"))), "_short": _compact_names("_kept")}, {"_edits": F.filter("_edits", lambda e: e["op"] != "equal")},
    )
    added = lambda e: F.substr(col("_right"), e["k"] + 1, e["l"] - e["k"])
    wrong = lambda e: (e["op"] != "insert") | ~added(e).rlike(f"^[{PARTICLES}]*$")
    # what comes after the first wrong edit isn't looked at
    until = F.aggregate("_edits", F.lit(1 << 30), lambda least, e: F.when(wrong(e), F.least(least, e["i"])).otherwise(least))
    df = _steps(df, {"_until": until}, {"_fine": F.filter("_edits", lambda e: ~wrong(e) & (e["i"] < col("_until")))})
    more = F.aggregate("_fine", F.lit(0), lambda s, e: s + e["l"] - e["k"])
    short = F.arrays_zip(col("_kept").alias("name"), col("_short").alias("short"))
    beside = lambda e: F.substr(col("_left"), F.greatest(e["i"] - 4, F.lit(0)) + 1, F.least(e["i"], F.lit(4)) + 4)
    close = lambda e: F.exists(short, lambda n: F.contains(col("_a"), n["name"]) & F.contains(beside(e), n["short"]))
    ends_asking = F.regexp_replace("_a", "[。.!！ ]+$", "").rlike(f"(?:{ASKING})$")
    families = {"numbers": NUMBER, "time": TIME, "negation": NEGATION, "roles": ROLE, "modality": MODAL}
    found = _reasons(col("_size"), [
        *(F.when(~same_bag(col("_a"), col("_b"), p), name) for name, p in families.items()), F.when(F.exists("_kept", lambda n: _count(col("_raw"), n) != _count(col("_made"), n)), "names"),
        F.when(~same_bag(col("_a"), col("_b"), LATIN), "latin"), F.when((_asks(col("_a")) != _asks(col("_b"))) & ~(ends_asking & _asks(col("_b"))), "question"), F.when(F.exists("_edits", wrong), "content"),
        F.when(F.exists("_fine", close), "near_name"), F.when(more > F.least(F.lit(2), F.greatest(F.lit(1), F.floor(F.length("_left") / 12))), "particles")])
    return df.withColumn(out, found).drop("_raw", "_made", "_names", "_size", "_a", "_b", "_kept", "_left", "_right", "_edits", "_short", "_until", "_fine")


_EN_TOKEN, _EN_FILLER = re.compile(EN_TOKEN), re.compile(EN_FILLER)


def _english_tokens(text: str | None) -> list[dict] | None:
    """Content tokens in order, and whether each is a pause filler that stands by itself."""
    if text is None:
        return None
    fillers = [m.span() for m in _EN_FILLER.finditer(text)]
    return [{"token": m[0].replace("’", "'").casefold(), "filler": any(s <= m.start() and m.end() <= e for s, e in fillers)} for m in _EN_TOKEN.finditer(text)]


@_kept_apart
@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("filler", T.BooleanType())])))
def english_tokens(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from in_pieces(text, _english_tokens, pa.list_(pa.struct([("token", pa.string()), ("filler", pa.bool_())])))


def english_names(raw: Column, names: Column) -> Column:
    """Names given and quoted, addresses and dotted words, and, unless all is upper case, acronyms and words of mixed case."""
    shouted = (F.upper(raw) == raw) & (F.lower(raw) != raw)
    odd = F.filter(_all(raw, LATIN), lambda w: ((F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)) | w.rlike("[a-z][A-Z]"))
    literals = F.transform(_all(raw, EN_LITERAL), lambda w: F.regexp_replace(w, "[.,;!?]+$", ""))
    return F.array_distinct(F.filter(F.concat(names, _all(raw, QUOTED, 1), literals, F.when(shouted, F.array().cast("array<string>")).otherwise(odd)), lambda n: n != ""))


def english_reasons(df: DataFrame, raw: Column, proposed: Column, names: Column, out: str) -> DataFrame:
    """Adds an array: why a rewrite of an English text can't stand (empty if it can).

    empty or long alone; numbers, negation (bags differ); names; question; content (anything but case, punctuation and fillers that stand by
    themselves). A null text is an empty one."""
    col = F.col
    fold = lambda t: F.lower(F.replace(t, F.lit("’"), F.lit("'")))
    ready = lambda t: english_tokens(F.when(col("_size").isNull(), t))
    only = lambda t: F.transform(t, lambda x: x["token"])
    df = _steps(
        df, *_given(raw, proposed, names), {"_kept": english_names(col("_raw"), col("_names")), "_left": ready(col("_raw")), "_right": ready(col("_made"))},
        {"_edits": opcodes(only("_left"), only("_right"))}, {"_edits": F.filter("_edits", lambda e: e["op"] != "equal")},
    )
    wrong = lambda e: (e["op"] != "delete") | F.exists(F.slice("_left", e["i"] + 1, e["j"] - e["i"]), lambda x: ~x["filler"])
    found = _reasons(col("_size"), [
        F.when(~same_bag(col("_raw"), col("_made"), EN_NUMBER), "numbers"), F.when(~same_bag(fold(col("_raw")), fold(col("_made")), EN_NEGATION), "negation"),
        F.when(F.exists("_kept", lambda n: _count(col("_raw"), n) != _count(col("_made"), n)), "names"), F.when(_asks(col("_raw")) != _asks(col("_made")), "question"), F.when(F.exists("_edits", wrong), "content")])
    return df.withColumn(out, found).drop("_raw", "_made", "_names", "_size", "_kept", "_left", "_right", "_edits")


# --- forms --------------------------------------------------------------------------------------------------------


def styled(raw: Column, style: str) -> Column:
    """natural (plain for colloquial words) or concise (without fillers), with a closing mark."""
    if style == "natural":
        return punctuated(canonical_register(raw))
    bare = F.regexp_replace(without_fillers(raw), "^[，,；; \\t\\n]+|[，,；; \\t\\n]+$", "")
    return punctuated(F.regexp_replace(bare, r"(?U)([，,])\s*[，,]+", "$1"))


def _english_styled(raw: Column, style: str) -> Column:
    t = raw
    if style == "concise":
        t = F.regexp_replace(F.regexp_replace(raw, EN_FILLER, ""), r"^[ ,;\t\r\n]+|[ ,;\t\r\n]+$", "")
        t = F.regexp_replace(t, r"(?U)([,;])\s*[,;]+", "$1")
    return F.when(t.rlike(r"[\p{L}\p{N}]$"), F.concat(t, F.lit("."))).otherwise(t)


def fast_forms(df: DataFrame, raw: Column, names: Column, out: str, english: bool = False) -> DataFrame:
    """Adds up to three forms of a text by rules alone: array of (label, text, changed, reasons).

    first is the text (punctuated, if it is Mandarin); natural and concise fall back to it where their guard has reasons, or the text is longer than
    240 characters. A text in the other script (Han in English, no Han in Mandarin) has only its first form; a blank or null one has none."""
    col = F.col
    reasons_of = english_reasons if english else mandarin_reasons
    df = _steps(df, {"_text": stripped(F.coalesce(raw, F.lit("")))}, {"_first": col("_text") if english else punctuated(col("_text"))})
    forms, helpers = [], ["_text", "_first", "_plain"]
    df = _steps(df, {"_plain": english_tokens("_text") if english else bare(_nfkc("_text"))})
    plain = F.transform("_plain", lambda x: x["token"]) if english else col("_plain")
    for style in ("natural", "concise"):
        made, why, shown, inner = f"_{style}", f"_{style}_why", f"_{style}_text", f"_{style}_inner"
        df = df.withColumn(made, F.when(F.length("_text") <= MOST_INPUT, _english_styled(col("_text"), style) if english else styled(col("_text"), style)).otherwise(col("_first")))
        df = reasons_of(df, col("_text"), col(made), names, why)
        df = _steps(df, {shown: F.when(F.size(why) > 0, col("_first")).otherwise(col(made))}, {inner: english_tokens(shown) if english else bare(_nfkc(shown))})
        now = F.transform(inner, lambda x: x["token"]) if english else col(inner)
        forms.append(F.struct(F.lit(style).alias("label"), col(shown).alias("text"), (now != plain).alias("changed"), col(why).alias("reasons")))
        helpers += [made, why, shown, inner]
    whole = F.struct(F.lit("first").alias("label"), col("_first").alias("text"), F.lit(False).alias("changed"), F.array().cast("array<string>").alias("reasons"))
    own = col("_text").rlike(_HAN) != F.lit(english)
    none = F.array().cast("array<struct<label:string,text:string,changed:boolean,reasons:array<string>>>")
    return df.withColumn(out, F.when(col("_text") == "", none).when(own, F.array(whole, *forms)).otherwise(F.array(whole))).drop(*helpers)


# --- corrections --------------------------------------------------------------------------------------------------

#: Starts of the window that a correction of Han text is looked for in; how much its length may differ.
STARTS, LONGER = 30, 2
_TOKEN, _WORDLIKE, _NO_HAN = re.compile(f"[{HAN}]|[a-z0-9]+(?:'[a-z]+)?", re.I), re.compile("[a-z0-9]", re.I), re.compile(f"[^{HAN}]+")


def tokens(text: str) -> list[str]:
    folded = unicodedata.normalize("NFKC", text).casefold().replace("’", "'")
    # without Latin letters and digits all tokens are single characters
    return _TOKEN.findall(folded) if _WORDLIKE.search(folded) else list(_NO_HAN.sub("", folded))


def _same(x: Sequence, y: Sequence, i: int, j: int, most: int) -> int:
    """How many elements of x from i on are those of y from j on; ``most`` at most, which neither may end before."""
    if most <= 0 or x[i] != y[j]:
        return 0
    n, step = 1, 8
    while n < most and x[i + n : i + min(n + step, most)] == y[j + n : j + min(n + step, most)]:
        n, step = min(n + step, most), 2 * step
    while n < most and step > 1:
        step //= 2
        if x[i + n : i + min(n + step, most)] == y[j + n : j + min(n + step, most)]:
            n = min(n + step, most)
    return n


def _near_windows(a: list[str], b: list[str], most: int) -> list[tuple[int, int, int, int]]:
    """The windows of b with the fewest edits, if ``most`` suffice: (edits, difference in length, start, length).

    For each start and diagonal of the table, the furthest row that so many edits reach; an edit more goes on from there, along what is the same."""
    x, y = "".join(a), "".join(b)
    x, y = (x, y) if len(x) == len(a) and len(y) == len(b) else (a, b)  # slices of strings are compared faster
    n, starts = len(a), min(len(b), STARTS)
    size = [min(len(b) - s, n + LONGER) for s in range(starts)]
    reached = [[0] for _ in range(starts)]
    found = []
    for edits in range(most + 1):
        for s, before in enumerate(reached):
            m, row = size[s], []
            for k in range(2 * edits + 1):
                d = k - edits
                # one more token of both, of b, or of a
                i = max(before[k - 1] + 1 if 0 < k < 2 * edits else 0, before[k - 2] if k > 1 else 0, before[k] + 1 if k < 2 * edits - 1 else 0)
                i = min(i, n, m - d)
                row.append(i + _same(x, y, i, s + i + d, min(n - i, m - i - d)) if i + d >= 0 and i >= 0 else i)
                if row[-1] == n and abs(d) <= LONGER and n + d > 0:
                    found.append((edits, abs(d), s, n + d))
            reached[s] = row
        if found:
            break
    return found


def _all_windows(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """All windows of b, as ``_near_windows`` has them: by bit vectors (see ``edit``), those of all starts side by side in one integer."""
    n, starts = len(a), min(len(b), STARTS)
    lane, out = n + 1, []
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    # each start has n bits, and one above that takes the carry
    first = sum(1 << s * lane for s in range(starts))
    whole = first * ((1 << n) - 1)
    up, down = whole, 0
    same = sum(places.get(b[s], 0) << (s + 1) * lane for s in range(starts - 1))
    for t in range(1, n + LONGER + 1):
        last = starts + t - 2
        same = same >> lane | (places.get(b[last], 0) if last < len(b) else 0) << (starts - 1) * lane
        across = ((same & up) + up & whole ^ up) | same
        more, less = down | ~(across | up) & whole, up & across
        more, less = (more << 1 | first) & whole, less << 1 & whole
        up, down = less | ~(same | down | more) & whole, more & (same | down)
        if t >= n - LONGER:
            for s in range(min(starts, len(b) - t + 1)):
                one = (1 << n) - 1 << s * lane
                out.append((t + (up & one).bit_count() - (down & one).bit_count(), abs(t - n), s, t))
    return out


def _han_correction(a: list[str], b: list[str]) -> str | None:
    """The window of b nearest to a: by edits, then difference in length, then place. None if it is a itself, or nothing is near.

    Few edits are tried first, the longer a text the more, so that this costs less than all windows do."""
    most, few = max(2, int(len(a) * 0.4)), 2 + len(a) // 50
    near = _near_windows(a, b, min(few, most))
    if not near and few < most:
        near = [w for w in _all_windows(a, b) if w[0] <= most]
    edits, _, start, length = min(near, default=(0, 0, 0, 0))
    return "".join(b[start : start + length]) if edits else None


@lru_cache(1 << 16)
def _short_word(word: str) -> str:
    return " ".join(tokens(word))


def _word_correction(a: list[str], span: str) -> str | None:
    """The words of the span that stand for those of a, if few were changed. What was typed before or after is trimmed off."""
    raw = span.split()
    plain = [_short_word(w) if len(w) <= 32 else " ".join(tokens(w)) for w in raw]
    edits = SequenceMatcher(None, a, plain, autojunk=False).get_opcodes()
    inner = [n for n, e in enumerate(edits) if e[0] != "insert"]
    if not inner:
        return None
    edits = [list(e) for e in edits[inner[0] : inner[-1] + 1]]
    # a replacement at either end that has over one word more than what it replaces took in words typed beside it
    for at, keep_end in ((-1, False), (0, True)):
        op, i, j, k, l = edits[at]  # noqa: E741
        if op == "replace" and l - k > j - i + 1:
            edits[at][3:] = (l - (j - i), l) if keep_end else (k, k + j - i)
    low, high = edits[0][3], edits[-1][4]
    fixed = [w for w in plain[low:high] if w]
    if fixed == a:
        return None
    match = SequenceMatcher(None, a, fixed, autojunk=False)
    changed = sum(max(j - i, l - k) for op, i, j, k, l in match.get_opcodes() if op != "equal")
    return " ".join(raw[low:high]) if match.ratio() >= 0.5 and changed <= max(2, 0.4 * len(a)) else None


def _correction(pasted: str | None, span: str | None) -> str | None:
    a = tokens(pasted or "")
    if not a or not (span or "").strip():
        return None
    if re.search(f"[{HAN}]", pasted):
        b = tokens(span)
        return _han_correction(a, b) if len(b) >= max(1, len(a) - LONGER) else None
    return _word_correction(a, span)


@F.arrow_udf(T.StringType())
def correction(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What became of a pasted text in ``span``, if it was corrected: null if it wasn't, or was written anew. Null texts are empty."""
    yield from in_pieces(batches, _correction, pa.string())
