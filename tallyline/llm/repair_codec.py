"""Token-id files with Re-Pair grammar compression.

A shard is the ids of consecutive documents (in ascending doc_id order). Frequent pairs of neighbouring ids are replaced by
nonterminals, round after round: a round counts all pairs, takes those near the top of the counts, and replaces their
non-overlapping occurrences, the more frequent first, until no pair is frequent enough. The shard's bytes hold the rules,
their expansion lengths, the remaining sequence and the documents' lengths; prefix sums of expansion lengths find any range
of ids without expanding the rest.

Shard bytes, little endian: magic ``RPG1``; uint32 counts of documents, rules and symbols; uint32 first nonterminal; uint64
ids in all; int64 doc_ids (and a bit for each that is null); uint32 lengths; uint32 left and right sides of the rules;
uint32 expansion lengths; uint32 symbols.

Defined cases: null text is empty (only the end id); rows that repeat a doc_id stay rows, in order of their text's hash; a
null doc_id comes first; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, text_chunks, text_only, word_tokenizer, written

MAGIC = b"RPG1"
FIRST_NONTERMINAL = 1 << 17
SHARD_IDS = 1 << 18
TOKENIZE_BYTES = 1 << 21
LEAST = 6
SLOT_BITS = 15
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Documents of a range partition, and the most partitions (the bound of what is gathered about them).
PART_ROWS, PARTS_MOST = 3000, 20_000


def compress(ids: np.ndarray, rounds: int | None = None, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules are (left, right) pairs, nonterminal FIRST_NONTERMINAL + i stands for rule i.

    Rounds go on until no pair of the symbols occurs ``least`` times (``rounds`` stops them before, None: never)."""
    s = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    made = done = 0
    # places whose pair may be frequent: a pair's count never rises once its symbols are there, so a place that drops out comes back only beside a new symbol
    live = np.arange(max(0, len(s) - 1))
    while len(live) and (rounds is None or done < rounds):
        done += 1
        key = s[live].astype(np.uint64) << np.uint64(32) | s[live + 1]
        ranked = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.diff(np.append(edge, len(ranked)))
        if counts.max() < least:
            break
        slots = (key * _SPREAD) >> np.uint64(64 - SLOT_BITS)
        table_live = np.zeros(1 << SLOT_BITS, bool)
        table_live[(ranked[edge[counts >= least]] * _SPREAD) >> np.uint64(64 - SLOT_BITS)] = True
        still = table_live[slots]
        live, key, slots = live[still], key[still], slots[still]
        chosen = np.flatnonzero(counts >= max(least, int(counts.max()) // 64))
        # the most frequent pair has the highest rank; equal counts by a hash, so that along a text ranks don't just rise or fall
        pairs = ranked[edge[chosen]]
        pairs = pairs[np.lexsort((pairs * _SPREAD, counts[chosen]))]
        # each place's pair is looked up in a table of slots; a pair that loses its slot to a more frequent one waits for a later round
        table_pair, table_rank = np.full(1 << SLOT_BITS, ~np.uint64(0)), np.zeros(1 << SLOT_BITS, np.int32)
        own = (pairs * _SPREAD) >> np.uint64(64 - SLOT_BITS)
        table_pair[own], table_rank[own] = pairs, np.arange(1, len(pairs) + 1)
        rank = np.where(table_pair[slots] == key, table_rank[slots], 0)
        # in a run of one id every other place counts, from its beginning
        run = np.flatnonzero(s[live] == s[live + 1])
        if len(run):
            place = np.arange(len(run))
            begins = np.concatenate([[True], np.diff(live[run]) != 1])
            rank[run[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 1]] = 0
        which = np.zeros(len(s) + 1, np.int32)  # ranks of the places one to the right, with a 0 at both ends
        which[live + 1] = rank
        open_ = live[rank > 0]
        taken = []
        left = which.copy()
        while len(open_):  # an occurrence goes before its neighbours if its pair is more frequent
            here = left[open_ + 1]
            at = open_[(here > left[open_]) & (here > left[open_ + 2])]
            taken.append(at)
            for near in (at, at + 1, at + 2):
                left[near] = 0
            open_ = open_[left[open_ + 1] > 0]
        at = np.sort(np.concatenate(taken))
        rank = which[at + 1]
        good = np.bincount(rank, minlength=len(pairs) + 1) >= 3  # a rule costs three numbers and saves one at each use
        number = np.cumsum(good) - 1
        at = at[good[rank]]
        if not len(at):  # only where least is under 5: of that many places the most frequent pair has three that don't overlap
            break
        keep, near = np.ones(len(s), bool), np.zeros(len(s), bool)
        keep[at + 1] = False
        near[live] = near[at] = near[np.maximum(at - 1, 0)] = True
        s[at] = (FIRST_NONTERMINAL + made + number[which[at + 1]]).astype(np.uint32)
        s = s[keep]
        live = np.flatnonzero(near[keep][:-1])
        own = pairs[np.flatnonzero(good) - 1]
        rules.append(np.stack([own >> np.uint64(32), own & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        made += len(own)
    return s, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule stands for; a rule's sides come before it."""
    out = np.ones(len(rules), np.int64)
    side = rules.astype(np.int64) - FIRST_NONTERMINAL
    if len(rules):
        # rounds make rules in order, so a few sweeps settle all
        while True:
            new = np.where(side >= 0, out[np.maximum(side, 0)], 1).sum(axis=1)
            if (new == out).all():
                return out
            out = new
    return out


@dataclass
class Shard:
    """A shard as read from its bytes."""

    doc_ids: np.ndarray
    nulls: np.ndarray
    lengths: np.ndarray
    rules: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray

    @staticmethod
    def of(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> Shard:
        symbols, rules = compress(ids)
        return Shard(np.array([x or 0 for x in doc_ids], np.int64), np.array([x is None for x in doc_ids], bool), lengths.astype(np.uint32), rules, expansion_lengths(rules).astype(np.uint32), symbols)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.doc_ids), len(self.rules), len(self.symbols), FIRST_NONTERMINAL], "<u4").tobytes() + np.array([self.lengths.sum(dtype=np.uint64)], "<u8").tobytes()
        parts = [self.doc_ids.astype("<i8"), np.packbits(self.nulls), self.lengths.astype("<u4"), self.rules.astype("<u4").T.copy(), self.sizes.astype("<u4"), self.symbols.astype("<u4")]
        return MAGIC + head + b"".join(x.tobytes() for x in parts)

    @staticmethod
    def from_bytes(raw: bytes) -> Shard:
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, rules, symbols, first = (int(x) for x in np.frombuffer(raw, "<u4", 4, 4))
        if first != FIRST_NONTERMINAL:
            raise ValueError("another alphabet")
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        own = take("<i8", docs), np.unpackbits(take("u1", (docs + 7) // 8), count=docs).astype(bool), take("<u4", docs), take("<u4", 2 * rules).reshape(2, -1).T, take("<u4", rules), take("<u4", symbols)
        return Shard(*own)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.sizes):
            return np.ones(len(symbols), np.int64)
        side = symbols.astype(np.int64) - FIRST_NONTERMINAL
        return np.where(side >= 0, self.sizes[np.maximum(side, 0)].astype(np.int64), 1)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for: every rule's expansion is laid out once, and gathered from there."""
        if not len(self.rules):
            return symbols
        flat = np.arange(len(self.rules), dtype=np.uint32) + np.uint32(FIRST_NONTERMINAL)
        while (inner := flat >= FIRST_NONTERMINAL).any():
            out = np.repeat(flat, np.where(inner, 2, 1))
            at = np.flatnonzero(inner)
            at = at + np.arange(len(at))
            pair = self.rules[flat[inner] - FIRST_NONTERMINAL]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            flat = out
        ends = np.cumsum(self.sizes, dtype=np.int64)
        # plain ids are looked up behind the expansions, where they stand for themselves
        plain, of = np.unique(symbols, return_inverse=True) if len(symbols) < 64 else (np.arange(FIRST_NONTERMINAL, dtype=np.uint32), symbols)
        rule = symbols >= FIRST_NONTERMINAL
        side = symbols[rule].astype(np.int64) - FIRST_NONTERMINAL
        begin, sizes = len(flat) + of.astype(np.int64), np.ones(len(symbols), np.int64)
        begin[rule], sizes[rule] = (ends - self.sizes)[side], self.sizes[side]
        places = np.cumsum(sizes) - sizes
        return np.concatenate([flat, plain])[np.repeat(begin - places, sizes) + np.arange(int(sizes.sum()))]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids [start, stop) of the shard; only the symbols that cover them are expanded."""
        if start == 0 and stop is None:
            return self._expand(self.symbols)
        ends = np.cumsum(self._sizes(self.symbols))
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        if stop <= start or first >= len(ends):
            return np.zeros(0, np.uint32)
        before = int(ends[first - 1]) if first else 0
        return self._expand(self.symbols[first : last + 1])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        at = int(self.lengths[:i].sum(dtype=np.int64))
        return self.ids(at, at + int(self.lengths[i]))


_FILE = pa.schema([("shard", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_symbols", pa.int64()), ("n_rules", pa.int64()), ("data", pa.binary())])


def _encode(path: str | None, end: int, shard_ids: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        total = number = before = 0

        def flush() -> pa.RecordBatch:
            shard = Shard.of(names, np.concatenate(lengths), np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((number, before, len(names), total, len(shard.symbols), len(shard.rules), shard.to_bytes()), _FILE, strict=True)], schema=_FILE)

        for batch in batches:
            own, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for at, data, offsets in text_chunks(column, TOKENIZE_BYTES):
                ids, begins = tokenizer.encode(data, offsets, end)
                first = 0
                while first < len(begins) - 1:
                    # the documents that still go into this shard: at least one, until it has its number of ids
                    last = max(first + 1, int(np.searchsorted(begins, begins[first] + shard_ids - total, "left")))
                    last = min(last, len(begins) - 1)
                    names += own[at + first : at + last]
                    held.append(ids[begins[first] : begins[last]])
                    lengths.append(np.diff(begins[first : last + 1]))
                    total += int(begins[last] - begins[first])
                    first = last
                    if total >= shard_ids:
                        yield flush()
                        before += total
                        names, held, lengths, total, number = [], [], [], 0, number + 1
        if names:
            yield flush()

    return run


def encoded(docs: DataFrame, tokenizer: str | None = None, end: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The file's rows: part, shard (both ascend with doc_id), before (the part's ids in earlier shards), n_docs, n_ids, n_symbols, n_rules, data (the shard's bytes)."""
    small_batches(docs.sparkSession)
    parts = min(PARTS_MOST, max(1, math.ceil(docs.select("doc_id").count() / PART_ROWS)))
    ordered = text_only(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    shards = ordered.mapInArrow(_encode(tokenizer, end, shard_ids), "shard long, before long, n_docs long, n_ids long, n_symbols long, n_rules long, data binary")
    return shards.select(F.spark_partition_id().cast("long").alias("part"), "*")


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, raw in zip(batch.column("start").to_pylist(), batch.column("data"), strict=True):
            shard = Shard.from_bytes(raw.as_py())
            ids, ends = memoryview(shard.ids().astype("<u4").tobytes()), np.cumsum(shard.lengths, dtype=np.int64)
            begins = ends - shard.lengths
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.nulls), pa.array(begins + start), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=_ROWS)


def decoded(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the file's rows alone."""
    small_batches(files.sparkSession)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row per part, PARTS_MOST at most
    bases = sizes.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "data")
    return placed.mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """Writes the documents' ids as a file in the shared folder and reads it back."""
    return decoded(written(encoded(docs, tokenizer, end), "token-ids"))
