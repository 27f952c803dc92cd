"""Edit distances as columns: characters by the built-in function, words by mapping them to characters, alignments by an Arrow UDF."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance(hypothesis: Column, reference: Column) -> Column:
    """Character edit distance of normalised strings (code points)."""
    return F.levenshtein(hypothesis, reference).cast("long")


#: Rows of an Arrow batch that a worker holds as Python values at a time; the others stay in Arrow. A piece ends before that where the rows' sizes come to MOST.
PIECE, MOST = 128, 100_000


def in_pieces(batches: Iterator, one, kind: pa.DataType, size=None) -> Iterator[pa.Array]:  # noqa: ANN001
    """``one`` of each row of Arrow batches (an array or a tuple of them), so that memory doesn't grow with what a batch of rows becomes.

    ``size``: of what a row becomes, if that can be large."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), PIECE):
            made, held = [], 0
            for r in zip(*(c.slice(at, PIECE).to_pylist() for c in columns), strict=True):
                made.append(one(*r))
                held += size(made[-1]) if size else 0
                if held >= MOST:
                    yield pa.array(made, kind)
                    made, held = [], 0
            if made:
                yield pa.array(made, kind)


def _characters_apart(a: str, b: str) -> int:
    """The edit distance by bit vectors (Myers, Hyyrö): a column of the table is two integers of len(a) bits, whose ones are steps up and down."""
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    last, whole = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, score = whole, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        across = ((same & up) + up ^ up) | same
        more, less = down | ~(across | up) & whole, up & across
        score += 1 if more & last else -1 if less & last else 0
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | ~(same | down | more) & whole, more & (same | down)
    return score


@F.arrow_udf(T.LongType())
def long_distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``distance`` for many pairs of long texts: the built-in function takes a step for each pair of characters."""
    yield from in_pieces(batches, lambda a, b: None if a is None or b is None else _characters_apart(a, b), pa.int64())


@F.arrow_udf(T.LongType())
def token_distance(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Edit distance of two token arrays."""
    yield from in_pieces(batches, lambda a, b: _tokens_apart(a or [], b or []), pa.int64())


def _tokens_apart(a: list[str], b: list[str]) -> int:
    row = np.arange(len(b) + 1)
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([number[w] for w in b], np.int64)
    steps = np.arange(len(b) + 1)
    for w in a:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (y != number[w]))
        # insertions run to the right: a running minimum of (value - place) gives them all at once
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


_EDIT = T.StructType([T.StructField(c, T.StringType()) for c in ("op", "ref", "hyp")])
ALIGNMENT = T.StructType([*(T.StructField(c, T.LongType()) for c in ("matches", "substitutions", "deletions", "insertions")), T.StructField("ops", T.ArrayType(_EDIT))])


#: Bytes of columns that a trace keeps at a time; parts that longer ones are dealt into.
KEPT, PARTS = 1 << 24, 16


def _columns(places: dict[str, int], hyp: str, rows: int, up: int, down: int) -> Iterator[tuple[int, int, int]]:
    """Columns of the table of edit distances, a bit for each row (as in ``_characters_apart``), after one of given steps: where the diagonal step is 0; steps up, steps down."""
    whole = (1 << rows) - 1
    for c in hyp:
        same = places.get(c, 0)
        across = ((same & up) + up ^ up) | same
        level = across | down
        more, less = down | ~(across | up) & whole, up & across
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | ~(same | down | more) & whole, more & (same | down)
        yield level, up, down


def _trace(ref: str, hyp: str, places: dict[str, int], i: int, up: int, down: int, ops: list[tuple[str, str, str]]) -> int:
    """Adds the edits, last one first, from row i behind ``hyp`` back to the column before it, whose steps are given; returns the row there.

    Keeps KEPT bytes of columns at most. Longer stretches are dealt into parts: what is before each is kept, and parts are gone through again from the last to the first."""
    whole = (1 << i) - 1
    up, down = up & whole, down & whole
    places = {c: at & whole for c, at in places.items()}
    if len(hyp) > PARTS and len(hyp) * i // 4 > KEPT:
        size = -(-len(hyp) // PARTS)
        before = [(up, down)]
        for j, (_, *steps) in enumerate(_columns(places, hyp[: (len(hyp) - 1) // size * size], i, up, down), 1):
            if j % size == 0:
                before.append(steps)
        for part in reversed(range(len(before))):
            i = _trace(ref, hyp[part * size : (part + 1) * size], places, i, *before[part], ops)
        return i
    kept = [(level, steps_up) for level, steps_up, _ in _columns(places, hyp, i, up, down)]
    j = len(hyp)
    while i and j:
        r, h, (level, steps_up) = ref[i - 1], hyp[j - 1], kept[j - 1]
        if r == h:
            i, j = i - 1, j - 1
        elif not level >> i - 1 & 1:
            i, j = i - 1, j - 1
            ops.append(("substitution", r, h))
        elif steps_up >> i - 1 & 1:
            i -= 1
            ops.append(("deletion", r, ""))
        else:
            j -= 1
            ops.append(("insertion", "", h))
    ops.extend(("insertion", "", h) for h in reversed(hyp[:j]))
    return i


def _aligned(ref: str, hyp: str) -> dict:
    """Alignment traced from the end; equal costs prefer the diagonal, then a deletion, then an insertion. Texts of any length: memory grows with their lengths, not with the table."""
    places: dict[str, int] = {}
    for i, c in enumerate(ref):
        places[c] = places.get(c, 0) | 1 << i
    ops: list[tuple[str, str, str]] = []
    rest = _trace(ref, hyp, places, len(ref), (1 << len(ref)) - 1, 0, ops)
    ops.extend(("deletion", r, "") for r in reversed(ref[:rest]))
    count = Counter(o for o, _, _ in ops)
    counts = {f"{kind}s": count[kind] for kind in ("substitution", "deletion", "insertion")}
    return {"matches": len(ref) - counts["substitutions"] - counts["deletions"], **counts, "ops": ops[::-1]}


_OPS = pa.list_(pa.struct([(c, pa.string()) for c in ("op", "ref", "hyp")]))
_ALIGNMENT = pa.struct([*((c, pa.int64()) for c in ("matches", "substitutions", "deletions", "insertions")), ("ops", _OPS)])


@lambda udf: udf.asNondeterministic()  # else the optimiser aligns once more for a condition on the edits
@F.arrow_udf(ALIGNMENT)
def alignment(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Counts of matches, substitutions, deletions and insertions, and the edits in order."""
    yield from in_pieces(batches, lambda r, h: _aligned(r or "", h or ""), _ALIGNMENT, size=lambda a: len(a["ops"]))
