"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention). Tasks tokenise their documents in whole and pack
them in groups of about GROUP_TOKENS tokens: as many sequences of ``capacity`` tokens as the group fills, and the rest in
sequences of a power of two tokens, so that no sequence needs padding. Documents, the costliest first, go to the sequence of
the lowest cost that has room; one that fits nowhere is cut, its head filling the roomiest sequence and its tail going back
into the queue. Groups are packed where their documents are read, so packing needs no shuffle; every id is in one piece.

Defined cases: null text is empty (its only id is the end id); rows that repeat a doc_id are packed one by one; ties go to
the earlier row and sequence; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches, text_chunks, text_only, word_tokenizer

CAPACITY = 4096
GROUP_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def cost(n: float) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents of these lengths (each at least 1)."""
    total = sum(lengths)
    full, rest = divmod(total, capacity)
    room = np.array([capacity] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)
    size, spent = room.copy(), np.zeros(len(room))
    out: list[tuple[int, int, int, int, int]] = []
    queue = []
    for d, n in enumerate(lengths):
        for start in range(0, n, capacity):
            heapq.heappush(queue, (-min(capacity, n - start), d, start))
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        # sequences of full length share the cost; the short ones take what fits nowhere else
        fits = np.flatnonzero(room[:full] >= n)
        if len(fits):
            at = int(fits[np.argmin(spent[fits])])
        else:
            short = full + np.flatnonzero(room[full:] >= n)
            at = int(short[np.argmin(room[short])]) if len(short) else int(np.argmax(room))
        take = min(n, int(room[at]))
        out.append((d, start, take, at, int(size[at] - room[at])))
        room[at] -= take
        spent[at] += cost(take)
        if take < n:
            heapq.heappush(queue, (take - n, d, start + take))
    return out


_SHAPE = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _packed(path: str | None, end: int, capacity: int, group: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 36
        names: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            lengths = [len(x) for x in held]
            pieces = sorted(pack(lengths, capacity), key=lambda x: (x[3], x[4]))
            crc = [zlib.crc32(held[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
            columns = [[names[d] for d, *_ in pieces], [x[1] for x in pieces], [x[2] for x in pieces], crc, [lengths[d] for d, *_ in pieces], [first + x[3] for x in pieces], [x[4] for x in pieces]]
            first += max((x[3] for x in pieces), default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SHAPE)

        for batch in batches:
            ids_of, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for at, data, offsets in text_chunks(column):
                ids, begins = tokenizer.encode(data, offsets, end)
                for i, (a, b) in enumerate(zip(begins[:-1], begins[1:], strict=True)):
                    held.append(ids[a:b])
                    names.append(ids_of[at + i])
                    total += int(b - a)
                    if total >= group:
                        yield flush()
                        names, held, total = [], [], 0
        if held:
            yield flush()

    return run


def packed(docs: DataFrame, tokenizer: str | None = None, end: int = 2, capacity: int = CAPACITY, group: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    return text_only(docs).mapInArrow(_packed(tokenizer, end, capacity, group), ", ".join(f"{f.name} long" for f in _SHAPE))
