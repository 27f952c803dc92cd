"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds what they miss.

The base spans (email, ip, card, phone) come from linear scans of the whole text. The tagger reads every character of every
text: windows overlap, and the best path over all of a text's windows decides (see char_tagger), so spans of any length and
at any place are found. It adds written-out, spaced or national forms of the four kinds, and keys (``secret``: tokens and
passwords given beside their name). Added spans never overlap a base span or each other, their path must lose at least
``margin`` without them, and numbers must be possible (a card's check digit, an ip's parts, a phone's number of digits).

It is trained on labelled spans: passages around base spans and plain ones, at most EACH + 1 of each of at most ``sample``
documents (the smallest hashes of doc_id), drawn from anywhere in the text; and ``made`` passages with made-up variants and
look-alikes (dates, versions, prices) set among words of those. Passages with a long run of letters and digits are left out
of the plain ones, since no label says whether that is a key.

Defined cases: null text is empty and has no spans; rows that repeat a doc_id are read one by one; other columns are
ignored (``masked`` keeps them all, whatever their names); without any passages the tagger is trained on the variants alone;
an empty table gives an empty table. A task's memory grows with its longest text, by about 100 bytes a character.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .char_tagger import PAD, Tagger, encode
from .common import small_batches, text_chunks, text_only, thinned

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Characters of a training window, and passages around base spans that a document gives at most.
WINDOW, EACH = 112, 4

# starts in the middle of a run of digits can only repeat what its first digit failed at
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[ord(c) for c in "0123456789@"]] = True


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        if (right := _DOMAIN.match(text, at)) and at > done:
            # the local part: the run of its characters before @, walked back in steps
            step, start = 64, at
            while True:
                low = max(done, at - step)
                run = _LOCAL_END.search(text[low:at])
                start = low + run.start() if run else at
                if start > low or low == done:
                    break
                step *= 4
            if start < at:
                found.append((start, right.end()))
                done = right.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans of each kind, in code points."""
    spans = lambda pattern, ok: [m.span() for m in pattern.finditer(text) if ok(m[0])]
    return {
        "email": _emails(text), "ip": spans(_IP, _ip_ok),
        "card": spans(_CARD, lambda s: 16 <= len(d := _digits(s)) <= 19 and luhn(d)), "phone": spans(_PHONE, lambda s: 8 <= len(_digits(s)) <= 15),
    }


# --- training ---------------------------------------------------------------------------------------------------


def _variants(rng: np.random.Generator) -> tuple[str, str, str, str | None]:
    """(what stands before, a made-up passage, what stands behind, its kind), or a look-alike that is none."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *x: x[rng.integers(len(x))]
    draw = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))

    def card() -> str:
        d = pick("4", "5", "37", "6011", num(4)) + num(16)
        d = d[:15]
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        sep = pick("", " ", "-", ".", " - ", "/")
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    kind = rng.integers(0, 14)
    if kind < 2:
        domain = pick(".", "-", "").join([word(3, 8), word(2, 6)]) + "." + pick("com", "org", "net", "de", "fr", "example")
        return "", word(2, 9) + pick(".", "_", "", "+") + pick(word(2, 8), num(2), word(2, 40)) + pick("@", "@", " @ ", "@ ", " @") + domain, "", "email"
    if kind < 4:  # spelled out
        at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", "."), (" (at) ", "."), (" [at] ", "."))
        host = dot.join([word(3, 9), pick("com", "org", "net", "de", "fr", "example")]) if rng.random() < 0.7 else dot.join([word(2, 6), word(3, 9), pick("com", "org", "net")])
        return "", pick(word(2, 9), word(2, 9) + dot + word(2, 9), word(2, 9) + num(2)) + at + host, "", "email"
    if kind < 5:
        return "", pick(".", " . ", "[.]").join(str(x) for x in rng.integers(0, 256, 4)), "", "ip"
    if kind < 6:
        return "", card(), "", "card"
    if kind < 8:
        a, b, c = num(3), num(3), num(4)
        return "", pick(f"+{pick('1', '33', '49', '34')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{pick('1', '44', '33')} {a} {b} {c}", f"00{pick('33', '49', '34')} {a} {b} {c}", f"{a} {b} {c}"), "", "phone"
    if kind < 10:
        name = pick("token", "api_key", "apikey", "secret", "password", "passwd", "key", "auth", "access_key", "client_secret", "session", word(3, 9) + "_key")
        value = pick(draw("0123456789abcdef", pick(32, 40, 40, 64)), draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", int(rng.integers(16, 90))), draw("abcdefghijkmnpqrstuvwxyz23456789!#%", int(rng.integers(10, 24))))
        quote = pick('"', '"', "'", "")
        return name + pick(" = ", "=", ": ", " : ", ":", " is ") + quote, value, quote, "secret"
    if kind < 11:  # words that repeat
        some = " ".join(word(2, 8) + pick("", "", ".", ",") for _ in range(rng.integers(1, 4)))
        return "", pick(" ", " ", "\n").join([some] * int(rng.integers(3, 40)))[:200], "", None
    plain = pick(
        f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", f"{rng.integers(1, 13)}/{rng.integers(1, 29)}/{rng.integers(1900, 2030)}", num(int(rng.integers(1, 8))),
        f"{rng.integers(0, 9)}.{rng.integers(0, 30)}", f"v{rng.integers(0, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}", f"${num(2)}.{num(2)}", f"{rng.integers(0, 24)}:{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"@{word(3, 9)}",
        f"{num(3)} {word(2, 7)} {num(2)}", f"{num(2)}-{num(2)}", f"{word(1, 3)}{num(2)}", f"{num(1)}{word(2, 3)}", f"ISBN 978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"look at {word(3, 8)}", f"at {word(3, 8)} dot", f"key {word(3, 8)}", f"token {word(3, 12)}",
        f"{word(12, 40)}", f'{word(3, 8)} = "{word(3, 9)}"', f"{word(3, 9)}.{word(2, 5)}", f"{num(2)} % {num(2)}", f"({num(3)})", f"#{num(4)}",
    )
    return "", plain, "", None


def training_set(passages: list[tuple[str, str]], made: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from corpus passages with their base spans, and from ``made`` variants set among corpus words."""
    rng = np.random.default_rng(seed)
    codes, gold = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        c, y = encode(text), np.zeros(len(text), np.int64)
        for k, a, b in spans:
            y[a] = 1 + 2 * k
            y[a + 1 : b] = 2 + 2 * k
        # a span that the window's edge cuts goes on as I
        at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        c, y = c[at : at + WINDOW], y[at : at + WINDOW]
        codes.append(np.pad(c, (0, WINDOW - len(c)), constant_values=PAD))
        gold.append(np.pad(y, (0, WINDOW - len(c))))

    words = [w for t, _ in passages for w in t.split() if not any(c.isdigit() or c == "@" for c in w)][:20_000] or ["the", "and", "of", "to", "in", "est", "und", "que"]
    some = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    for t, spans in passages:
        add(t, [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)])
    for _ in range(made):
        before, middle, behind, kind = _variants(rng)
        head = (some(rng.integers(1, 12)) + rng.choice([" ", " ", " ", "\n", ", "])) if rng.random() < 0.9 else ""
        head = head[-int(rng.integers(16, 90)) :] + before
        tail = behind + (rng.choice([" ", " ", ". ", ", ", "\n", "!! ", "*** ", " | ", "### "]) + some(rng.integers(1, 12)) if rng.random() < 0.9 else "")
        text = head + middle + tail
        shape = rng.random()
        if shape < 0.1 and len(text.upper()) == len(text):
            text = text.upper()
        add(text, [(KINDS.index(kind), len(head), len(head) + len(middle))] if kind else [])
    return np.array(codes), np.array(gold)


_TRAINED: dict[tuple[str, int, int], Tagger] = {}


def trained(passages: list[tuple[str, str]], steps: int, made: int = 5000) -> Tagger:
    """The tagger of these passages; the last one trained in this process is kept."""
    key = (hashlib.sha256(repr(passages).encode()).hexdigest(), steps, made)
    if key not in _TRAINED:
        tagger = Tagger.new(len(KINDS))
        tagger.fit(*training_set(passages, made), steps)
        _TRAINED.clear()
        _TRAINED[key] = tagger
    return _TRAINED[key]


_KEYLIKE = re.compile(r"(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{12,}")
_PASSAGE = pa.schema([("place", pa.float64()), ("number", pa.int64()), ("passage", pa.string()), ("spans", pa.string())])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training passages of each text: around some of its base spans, and a plain one, all drawn by a hash of the text."""
    for batch in batches:
        out = []
        for place, text in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rng = np.random.default_rng(zlib.crc32(text.encode()))
            spans = sorted((a, b, k) for k, own in base_spans(text).items() for a, b in own)
            # a span longer than a window teaches nothing, and would go to the driver whole
            short = [s for s in spans if s[1] - s[0] <= WINDOW]
            picks = [short[i][:2] for i in rng.permutation(len(short))[:EACH]] + [(at := int(rng.integers(0, len(text) + 1)), at)]
            for number, (a, b) in enumerate(picks):
                low, high = max(0, a - int(rng.integers(8, 90))), min(len(text), b + int(rng.integers(8, 90)))
                touched = [s for s in spans if s[0] < high and s[1] > low]
                rest = list(text[low:high])
                for x, y, _ in touched:
                    rest[max(0, x - low) : max(0, y - low)] = " " * (min(high, y) - max(low, x))
                whole = all(low <= x and y <= high for x, y, _ in touched) and all(s[1] <= t[0] for s, t in zip(touched[:-1], touched[1:], strict=True))
                if high > low and whole and not _KEYLIKE.search("".join(rest)):
                    out.append((place, number, text[low:high], ",".join(f"{k}:{x - low}:{y - low}" for x, y, k in touched)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _PASSAGE, strict=True)], schema=_PASSAGE)


def learned(docs: DataFrame, sample: int, steps: int) -> Tagger:
    """The tagger; at most (EACH + 1) * 1.5 * ``sample`` passages of a document's text reach the driver, and nothing else does."""
    few = thinned(text_only(docs), sample, "doc_id").select("place", "text").mapInArrow(_passages, "place double, number long, passage string, spans string")
    got = few.dropDuplicates(["place", "number"]).toPandas().sort_values(["place", "number"])
    keep = got["place"].isin(got["place"].drop_duplicates()[:sample])
    return trained(list(zip(got["passage"][keep], got["spans"][keep], strict=True)), steps)


# --- reading ----------------------------------------------------------------------------------------------------


#: Characters of the longest valid address (a fixed value of mail transport).
MOST_ADDRESS = 254


def _possible(kind: str, s: str, beside: str) -> bool:
    """Whether the numbers of an added span can be of its kind, and are whole (no digit stands ``beside`` them); an address isn't longer than any can be and has all its parts, a key holds no white space."""
    if kind == "secret":
        return not any(map(str.isspace, s))
    if kind == "email":
        # a name, a host and its domain, and where there is no @ a word for it
        parts = re.findall(r"[^\W_]+", s.lower())
        return len(s) <= MOST_ADDRESS and len(parts) >= (3 if "@" in s else 4) and len(set(parts)) >= 3
    if kind in ("ip", "card", "phone") and _digits(beside):
        return False
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and _ip_ok(".".join(parts))
    if kind == "card":
        return 13 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind != "phone" or 7 <= len(_digits(s)) <= 15


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS if k in spans for a, b in sorted(spans[k]))


def added(tagger: Tagger, texts: list[str], base: list[dict[str, list[tuple[int, int]]]], margin: float) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the spans that the tagger adds to each text's base spans."""
    out = []
    for text, own, found in zip(texts, base, tagger.spans([encode(t) for t in texts]), strict=True):
        taken = np.zeros(len(text) + 1, bool) if found else None
        for spans in own.values() if found else ():
            for a, b in spans:
                taken[a:b] = True
        kept = []
        for k, a, b, lost in found:
            s = text[a:b]
            a, b = a + len(s) - len(s.lstrip(" .,;:\n\"'")), b - len(s) + len(s.rstrip(" .,;:\n\"'"))
            if lost >= margin and a < b and not taken[a:b].any() and _possible(KINDS[k], text[a:b], text[max(0, a - 1) : a] + text[b : b + 1]):
                kept.append((KINDS[k], a, b))
        out.append(kept)
    return out


def _read(tagger: Tagger, column: pa.Array, margin: float) -> Iterator[tuple[int, list[str], list[dict[str, list[tuple[int, int]]]], list[list[tuple[str, int, int]]]]]:
    """(first row, texts, base spans, added spans) of runs of rows; texts without a digit or @ have no base spans."""
    for first, data, offsets in text_chunks(column):
        rows = len(offsets) - 1
        hits = np.concatenate([[0], np.cumsum(_TRIGGER[data])])[offsets]
        near = hits[1:] > hits[:-1]
        texts = column.slice(first, rows).fill_null("").to_pylist()
        base = [base_spans(t) if n else {k: [] for k in BASE} for t, n in zip(texts, near, strict=True)]
        yield first, texts, base, added(tagger, texts, base, margin)


def personal_data(docs: DataFrame, sample: int = 10_000, steps: int = 350, margin: float = 1.0) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans (base and added, as kind:start:end), n_spans and n_added of every document."""
    small_batches(docs.sparkSession)
    tagger = learned(docs, sample, steps)
    shape = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), ("n_added", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for first, _, base, more in _read(tagger, batch.column("text"), margin):
                counts = [[len(x[k]) for x in base] for k in BASE]
                digest = [hashlib.sha256(joined(x).encode()).hexdigest() for x in base]
                both = [x | {k: [*x.get(k, []), *((a, b) for kind, a, b in new if kind == k)] for k in KINDS} if new else x for x, new in zip(base, more, strict=True)]
                n = [len(x) for x in more]
                total = [sum(map(len, x.values())) for x in both]
                yield pa.RecordBatch.from_arrays([names.slice(first, len(base)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([joined(x) for x in both], pa.string()), pa.array(total, pa.int64()), pa.array(n, pa.int64())], schema=shape)

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return text_only(docs).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long, n_added long")


def masked(docs: DataFrame, mark: str = "[{}]", sample: int = 10_000, steps: int = 350, margin: float = 1.0) -> DataFrame:
    """``docs``, row by row, with every span's characters replaced by its kind's mark; null text stays null, all other columns stay as they are."""
    small_batches(docs.sparkSession)
    tagger = learned(docs, sample, steps)
    # by number, so that other columns may have any name
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for first, texts, base, more in _read(tagger, column.cast(pa.string()), margin):
                part = batch.slice(first, len(texts))
                new = [redacted(t, [(k, *s) for k in BASE for s in x[k]] + own, mark) if own or any(x.values()) else t for t, x, own in zip(texts, base, more, strict=True)]
                nulls = part.column(at).is_null().to_numpy(zero_copy_only=False)
                yield part.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type, mask=nulls))

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with its spans replaced; overlapping ones as one, by the first's mark."""
    out, done = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], mark.format(k.upper())]
        done = max(done, -b)
    return "".join([*out, text[done:]])
