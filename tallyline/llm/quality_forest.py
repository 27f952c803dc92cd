"""Quality rules: per-document rule statistics, fixed limits, and isolation forests over the statistics.

Statistics are taken over every whole text in one pass of numpy kernels on Arrow buffers. There is a forest for each group
of rules (symbols, case, repetition, shape), fitted on at most ``sample`` labelled rows that pass the fixed limits (the
smallest hashes of doc_id); trees draw TREE_ROWS of them and split at random. A document's anomaly score is
2 ** (-mean path length / expected path length). Each forest's threshold comes from all labelled rows: the lowest score from
which at most ``most_lost`` of the good rows lie and junk outnumbers good by ``least_odds``; a forest whose high scores
don't single out junk rejects nothing. Documents under the fixed limits never pass.

Defined cases: null text has no words and fails; no labelled junk (or no labels) leaves only the fixed limits; rows that
repeat a doc_id are scored one by one; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, hash_sample, small_batches, span_hashes, text_chunks, text_only, window_hashes, word_spans, written

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_marks", "n_lines")
TREES, TREE_ROWS = 128, 256
BINS = 4000


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_SYMBOL, _IS_UPPER, _IS_DIGIT, _IS_MARK = _kind(SYMBOLS), _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789"), _kind(".,;:!?")
_IS_HEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each row."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, data, offsets in text_chunks(column):
        rows = len(offsets) - 1
        starts, ends, at = word_spans(data, offsets)
        per_row = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])
        words = span_hashes(data, starts, ends)
        grams = window_hashes(words, 3)
        repeat, distinct, dup = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        breaks = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
        line_start, line_end = breaks[:-1], breaks[1:].copy()
        has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
        line_start, line_end = line_start[has_word], line_end[has_word]
        line_end -= data[line_end - 1] == 10
        lines = span_hashes(data, line_start, line_end)
        first_line = np.searchsorted(line_start, offsets)
        for i in range(rows):
            a, b = at[i], at[i + 1]
            w = np.sort(words[a:b])
            distinct[i] = len(w) - np.count_nonzero(w[1:] == w[:-1])
            if b - a >= 3:
                h = grams[a : b - 2]
                s = np.sort(h)
                twice = s[1:][s[1:] == s[:-1]]
                if len(twice):
                    hit = np.isin(h, twice)
                    cover = np.zeros(b - a, bool)
                    for j in range(3):
                        cover[j : j + len(h)] |= hit
                    repeat[i] = np.count_nonzero(cover)
            own = lines[first_line[i] : first_line[i + 1]]
            if len(own) > 1:
                dup[i] = len(own) - len(np.unique(own))
        found = {
            "n_words": np.diff(at), "word_chars": per_row(_IS_HEAD[data] & ~_SPACE[data]), "n_symbols": per_row(_IS_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeat,
            "n_distinct": distinct, "n_upper": per_row(_IS_UPPER[data]), "n_digits": per_row(_IS_DIGIT[data]), "n_marks": per_row(_IS_MARK[data]), "n_lines": np.diff(first_line),
        }
        for c in COUNTS:
            parts[c].append(found[c].astype(np.int64))
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in parts.items()}


def features(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rule statistics by group, none of which follows a document's length."""
    words = np.maximum(x["n_words"], 1).astype(float)
    chars = np.maximum(x["word_chars"], 1).astype(float)
    symbols, upper, digits = (np.sqrt(x[c] / chars) for c in ("n_symbols", "n_upper", "n_digits"))
    # a longer text has relatively fewer distinct words; log-log takes that out
    distinct = np.log(np.maximum(x["n_distinct"], 1)) / np.log(words + 1)
    return {
        "symbols": np.stack([symbols, np.minimum(x["n_symbols"] / words, 3.0)], axis=1),
        "case": np.stack([upper, x["n_marks"] / chars], axis=1),
        "repetition": np.stack([distinct, x["n_repeat_words"] / words, x["n_dup_lines"] / np.maximum(x["n_lines"], 1)], axis=1),
        "shape": np.stack([chars / words, digits], axis=1),
    }


GROUPS = ("symbols", "case", "repetition", "shape")


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: split column (-1: leaf), split value, left child (the right one follows), path length at a leaf."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    path: np.ndarray
    norm: float

    @staticmethod
    def fit(rows: np.ndarray, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        take = min(TREE_ROWS, len(rows))
        depth_most = int(np.ceil(np.log2(max(take, 2))))
        trees = []
        for _ in range(TREES):
            column, value, child, path = [0], [0.0], [0], [0.0]
            todo = [(0, rows[rng.choice(len(rows), take, replace=False)], 0)]
            while todo:
                at, own, depth = todo.pop()
                lo, hi = own.min(axis=0), own.max(axis=0)
                open_ = np.flatnonzero(hi > lo)
                if depth >= depth_most or len(own) <= 1 or not len(open_):
                    column[at], path[at] = -1, depth + expected_path(len(own))
                    continue
                c = int(rng.choice(open_))
                v = float(rng.uniform(lo[c], hi[c]))
                column[at], value[at], child[at] = c, v, len(column)
                for part in (own[own[:, c] <= v], own[own[:, c] > v]):
                    todo.append((len(column), part, depth + 1))
                    column.append(0), value.append(0.0), child.append(0), path.append(0.0)
            trees.append((column, value, child, path))
        size = max(len(t[0]) for t in trees)
        fill = lambda i, kind: np.array([list(t[i]) + [0] * (size - len(t[i])) for t in trees], kind)
        return Forest(fill(0, np.int64), fill(1, float), fill(2, np.int64), fill(3, float), max(expected_path(take), 1e-9))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for column, value, child, path in zip(self.column, self.value, self.child, self.path, strict=True):
            at = np.zeros(len(rows), np.int64)
            while True:
                c = column[at]
                inner = c >= 0
                if not inner.any():
                    break
                step = child[at] + (rows[each, np.maximum(c, 0)] > value[at])
                at = np.where(inner, step, at)
            total += path[at]
        return 2.0 ** (-total / len(self.column) / self.norm)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of every document."""
    small_batches(docs.sparkSession)
    names = ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x[c]) for c in COUNTS)], names=["doc_id", *COUNTS])

    return text_only(docs).mapInArrow(run, f"doc_id long, {names}")


SCORES = [f"score_{g}" for g in GROUPS]


@dataclass
class Judge:
    """Fixed limits, and a forest and the score from which it rejects for each group of rules (no forests: the limits alone)."""

    forests: dict[str, Forest]
    limits: dict[str, float]
    least_words: int
    most_repeat: int

    def base_failed(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return (x["n_words"] < self.least_words) | (100 * x["n_repeat_words"] > self.most_repeat * x["n_words"])

    def scores(self, x: dict[str, np.ndarray]) -> list[np.ndarray]:
        rows = features(x)
        return [self.forests[g].score(rows[g]) if g in self.forests else np.zeros(len(x["n_words"])) for g in GROUPS]

    def kept(self, x: dict[str, np.ndarray], scores: list[np.ndarray]) -> np.ndarray:
        out = ~self.base_failed(x)
        for g, score in zip(GROUPS, scores, strict=True):
            out &= score < self.limits.get(g, 2.0)
        return out


def fitted(stats: DataFrame, labels: DataFrame, sample: int = 20_000, most_lost: float = 0.001, least_odds: float = 20.0, least_words: int = 50, most_repeat: int = 50) -> Judge:
    """The judge that the labelled rows of ``stats`` make: forests from at most ``sample`` of them, limits from all."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    known = written(stats.where(~base).join(marked, "doc_id"), "quality-labelled")
    fit = hash_sample(known, sample, "doc_id", *COUNTS).select(*COUNTS).toPandas()
    judge = Judge({}, {}, least_words, most_repeat)
    if len(fit):
        judge.forests = {g: Forest.fit(rows) for g, rows in features({c: fit[c].to_numpy() for c in COUNTS}).items()}
        scored = known.mapInArrow(_scored(judge, ["quality"]), f"quality long, {', '.join(f'{c} double' for c in SCORES)}")
        judge.limits = thresholds(scored, most_lost, least_odds)
    return judge


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}


def _scored(judge: Judge, also: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.int64()) for c in also), *map(pa.array, judge.scores(_counts(batch)))], names=[*also, *SCORES])

    return run


def judged(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """doc_id, the COUNTS, base_failed, a score_<group> (anomaly, 0 to 1) for each group of rules, and kept."""
    stats = written(statistics(docs), "quality-stats")
    judge = fitted(stats, labels, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _counts(batch)
            scores = judge.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores), pa.array(judge.base_failed(x)), pa.array(judge.kept(x, scores))], names=[*batch.schema.names, *SCORES, "base_failed", "kept"])

    kinds = [*(f"{c} long" for c in ("doc_id", *COUNTS)), *(f"{c} double" for c in SCORES), "base_failed boolean", "kept boolean"]
    return stats.mapInArrow(run, ", ".join(kinds))


def kept_rows(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by itself, with all their columns, whatever these are called; texts are read a second time instead of being shuffled."""
    judge = fitted(written(statistics(docs), "quality-stats"), labels, **limits)
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_counts(batch.column(at).cast(pa.string()))
            yield batch.filter(pa.array(judge.kept(x, judge.scores(x))))

    return docs.mapInArrow(run, docs.schema)


def thresholds(scored: DataFrame, most_lost: float, least_odds: float) -> dict[str, float]:
    """For each group the lowest score bin from which at most ``most_lost`` of the good rows lie, with ``least_odds`` as many junk rows; 2 if there is none."""
    one = F.explode(F.array(*(F.struct(F.lit(g).alias("rules"), F.col(c).alias("score")) for g, c in zip(GROUPS, SCORES, strict=True)))).alias("x")
    bins = scored.select("quality", one).groupBy("x.rules", F.least(F.floor(F.col("x.score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    bins = bins.agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("junk")).toPandas()  # BINS rows of each group at most
    out = {}
    for g in GROUPS:
        own = bins[bins["rules"] == g]
        good, junk = np.zeros(BINS), np.zeros(BINS)
        good[own["bin"].to_numpy(np.int64)], junk[own["bin"].to_numpy(np.int64)] = own["good"], own["junk"]
        above, caught = (np.cumsum(x[::-1])[::-1] for x in (good, junk))
        allowed = np.flatnonzero((above <= most_lost * good.sum()) & (caught >= least_odds * above) & (caught > 0))
        out[g] = allowed[0] / BINS if len(allowed) else 2.0
    return out
