"""What the corpus operators share: written tables, word hashing on Arrow buffers, tokenising, components."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bytes of text that numpy kernels take at a time; bounds a task's memory whatever a batch holds.
CHUNK_BYTES = 1 << 20

#: Rows of an Arrow batch. A long text is at most some 100 KB here, so a batch stays in the tens of MB.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark reads the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts need Arrow batches of few rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_only(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id and text (null: empty), and the columns asked for; others do not reach the operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *also)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_2, name_3, ... that no column of ``df`` has (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(1, len(taken) + 2) if (n := name if i == 1 else f"{name}_{i}").lower() not in taken)


def thinned(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """The rows whose hash of ``keys`` (column ``place``, 0 to 1) is under a threshold that follows from the count: about 1.5 times ``most``, more only where keys repeat."""
    share = min(1.0, (1.5 * most + 50) / max(1, df.count()))
    return df.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *keys), 11) / float(1 << 53)).where(F.col("place") < share)


def hash_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows: those with the smallest hashes of ``keys``, rows that repeat all of these as one.

    Only rows under the threshold go on, so what tasks send to the driver doesn't grow with their number, and a hot key is one row."""
    return thinned(df, most, *keys).dropDuplicates(["place"]).orderBy("place").limit(most).drop("place")


# --- words on Arrow buffers -------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


LONG_SPAN = 512
#: The first j bytes of a little-endian 8-byte block.
_FIRST_BYTES = np.array([(1 << 8 * j) - 1 for j in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans of ``data``; equal bytes have equal hashes wherever they stand.

    Spans are mixed 8 bytes at a time, all spans at once and the longer ones on; each step is bijective in the block, so spans
    of up to 8 bytes that differ never meet, and no sum or power lets patterns of bytes cancel out. Spans of over LONG_SPAN
    bytes take BLAKE2b, one by one."""
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(np.uint64) * _M3 + np.uint64(seed))
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    live = np.flatnonzero(length <= LONG_SPAN)
    if len(live) < len(starts):
        long = np.flatnonzero(length > LONG_SPAN)
        key = seed.to_bytes(8, "little")
        h[long] = [int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8, key=key).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    at, left = starts[live], length[live]
    while len(live):
        h[live] = mix(h[live] * _M2 ^ blocks[at] & _FIRST_BYTES[np.minimum(left, 8)])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a string column, of ``most`` bytes or a single longer row; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the count at last) of the words ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words that begin at each word (those past a row's end are for the caller to drop)."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * _M3 + words[i : i + n])
    return h


# --- tokenising ------------------------------------------------------------------------------------------------


_LETTER = np.zeros(256, np.uint8)  # 1: letter, 2: digit, 0: any other
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_LETTER[48:58] = 2


_ODD = re.compile(rb"'|<\||[\xc2\xc4-\xff]|\xc3[\x97\xb7]")


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, a white-space piece at a time.

    The tokenizer's rules never join text across ASCII white space (it drops it), so a text's ids are those of its pieces
    in order. Each piece (known by a 64-bit hash) is encoded by the library once, many in one call, and kept in a table;
    when the table holds ``most`` pieces, those met only once go."""

    def __init__(self, path: str | None = None, most: int = 1_000_000) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.most = most
        self.names = np.zeros(0, np.uint64)  # hashes of the pieces, ascending, and the number of each
        self.number = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1, np.int64)  # where each piece's ids begin in flat, and the end at last
        self.met = np.zeros(0, np.int32)
        words = self.inner.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _shrink(self) -> None:
        keep = self.met > 1
        keep &= keep.sum() <= self.most // 2
        number = np.cumsum(keep) - 1
        lengths = np.diff(self.first)
        flat = self.flat[: self.first[-1]][np.repeat(keep, lengths)]
        stays = keep[self.number]
        self.names, self.number = self.names[stays], number[self.number[stays]]
        self.flat, self.first, self.met = flat, np.concatenate([[0], np.cumsum(lengths[keep])]), np.ones(int(keep.sum()), np.int32)

    def _counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after another, and how many each has."""
        joined = b" ".join(pieces)
        text = joined.decode()
        raw = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]
        wide = np.flatnonzero(raw >= 0x80)
        heads = wide[raw[wide] >= 0xC0]
        plain = 39 not in raw and (raw[heads] == 0xC3).all() and not np.isin(raw[heads + 1], (0x97, 0xB7)).any() and b"<|" not in joined
        if plain:
            # words by the tokenizer's own pattern: runs of letters, single digits, runs of others; each ends in one </w> id
            got = self.inner.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(got.ids, np.int64)
            kind, space = _LETTER[raw], raw == 32
            new = np.ones(len(raw), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | space[:-1]
            words = np.add.reduceat((new & ~space).astype(np.int64), begins)
            last = np.flatnonzero(self.ends_word[ids])
            if len(last) == words.sum():
                return ids.astype(np.uint32), np.diff(np.concatenate([[0], last[np.cumsum(words) - 1] + 1]))
        got = self.inner.encode(text, add_special_tokens=False)
        places = np.cumsum([0, *(len(p.decode()) + 1 for p in pieces)])
        of = np.searchsorted(places, np.fromiter((a for a, _ in got.offsets), np.int64, len(got.ids)), "right") - 1
        return np.array(got.ids, np.uint32), np.bincount(of, minlength=len(pieces))

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """The numbers that the pieces get."""
        # pieces that the quick count can't take are kept apart, so that few calls need offsets
        odd = [_ODD.search(p) is not None for p in pieces]
        numbers = np.empty(len(pieces), np.int64)
        for flag in (False, True):
            at = [i for i, o in enumerate(odd) if o == flag]
            for k in range(0, len(at), 2000):
                part = at[k : k + 2000]
                ids, counts = self._counts([pieces[i] for i in part])
                ends = self.first[-1] + np.cumsum(counts)
                if ends[-1] > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(ends[-1]) - len(self.flat)), np.uint32)])
                self.flat[self.first[-1] : ends[-1]] = ids
                numbers[part] = np.arange(len(part)) + len(self.first) - 1
                self.first = np.concatenate([self.first, ends])
        self.met = np.concatenate([self.met, np.zeros(len(self.first) - 1 - len(self.met), np.int32)])
        return numbers

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a chunk, one after another, each row followed by id ``end`` if there is one; and where each row begins, and the end."""
        if len(self.names) > self.most:
            self._shrink()
        starts, ends, at = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        one = order[new]  # a place of each distinct piece
        names = ranked[new]
        place = np.searchsorted(self.names, names)
        known = np.append(self.names, 0)[place] == names
        known &= place < len(self.names)
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = data.tobytes()
            a, b = starts[one[missing]].tolist(), ends[one[missing]].tolist()
            numbers = self._learn([raw[x:y] for x, y in zip(a, b, strict=True)])
            self.names, self.number = (np.insert(x, place[missing], y) for x, y in ((self.names, names[missing]), (self.number, numbers)))
            place = np.searchsorted(self.names, names)
        found = self.number[place]
        self.met[found] += 1
        piece = np.empty(len(order), np.int64)
        piece[order] = found[np.cumsum(new) - 1]
        begin, lengths = self.first[piece], self.first[piece + 1] - self.first[piece]
        places = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        begins = places[at]
        ids = self.flat[np.repeat(begin - places[:-1], lengths) + np.arange(places[-1])]
        if end is None:
            return ids, begins
        closed = np.full(len(ids) + len(offsets) - 1, end, np.uint32)
        for r, (x, y) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
            closed[x + r : y + r] = ids[x:y]
        return closed, begins + np.arange(len(begins))


_TOKENIZERS: dict[str | None, WordTokenizer] = {}


def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """This process's tokenizer of ``path``; Python workers serve many tasks and keep its table."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# --- connected components --------------------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the component's smallest node.

    Each round hooks every node to its smallest neighbour and contracts the edges, so the edge table shrinks by a
    constant factor a round; ids should be hash-like, which keeps the number of rounds logarithmic. Only sums reach
    the driver; each round's tables are written to the shared folder."""
    spark = edges.sparkSession
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), f"{name}-hook")
        maps.append(hook)
        to = lambda side: hook.select(F.col("node").alias(side), F.col("up").alias(f"{side}2"))
        edges = written(
            edges.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-edges",
        )
    else:
        raise RuntimeError("components did not converge")
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    found = maps[-1].select("node", F.col("up").alias("root"))
    for hook in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("up"), F.col("root").alias("top"))
        found = hook.join(later, "up", "left").select("node", F.coalesce("top", "up").alias("root"))
    return written(found, f"{name}-roots")
