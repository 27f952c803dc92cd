"""Language identification with a byte convolutional network, in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes (the last one padded). Byte vectors run through filters of
several widths, each filter's largest answer over the window (with ReLU) feeds a softmax over the languages, and a text's
probabilities come from the mean of its windows' log-probabilities. Every window of every text is read.

The network learns only from documents that aren't held out (crc32 of the doc_id's text modulo 5 is not 0) and have a
language: at most ``sample`` of each language, those with the smallest hashes (and at most ``most`` of all languages), and
WINDOWS_EACH windows drawn from each whole text. Only these windows reach the driver.

Defined cases: null text, and text without a letter (``str.isalpha`` of no character; digits, fractions and marks are none), is ``und`` with score 0; rows that repeat a doc_id are read one by one;
no labelled rows make every text ``und``; one language has score 1; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_chunks

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, SIZE = 16, 8
WINDOWS_EACH = 4
UNKNOWN = "und"
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Network:
    """emb (257, SIZE; 256 is padding), filters (max width * SIZE, filters; narrower ones padded by zeros), out."""

    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def new(labels: int, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        wide = max(WIDTHS)
        filters = rng.normal(size=(wide * SIZE, FILTERS * len(WIDTHS))).astype(np.float32) * Network.mask() / np.sqrt(wide * SIZE / 2)
        n = FILTERS * len(WIDTHS)
        return Network(rng.normal(size=(257, SIZE)).astype(np.float32), filters, np.zeros(n, np.float32), rng.normal(size=(n, labels)).astype(np.float32) / np.sqrt(n), np.zeros(labels, np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        out = np.zeros((max(WIDTHS) * SIZE, FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            out[: w * SIZE, i * FILTERS : (i + 1) * FILTERS] = 1
        return out

    def _views(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW, max width * SIZE) of windows (n, WINDOW + max width - 1) of bytes."""
        x = np.take(self.emb, windows, axis=0)
        n, length, size = x.shape
        wide = max(WIDTHS)
        return np.lib.stride_tricks.as_strided(x, (n, length - wide + 1, wide * size), (x.strides[0], x.strides[1], x.itemsize))

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        views = self._views(windows)
        return np.maximum((views.reshape(-1, views.shape[2]) @ self.filters).reshape(*views.shape[:2], -1).max(axis=1) + self.bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _log_softmax(self.pooled(windows) @ self.out + self.out_bias)

    def fit(self, windows: np.ndarray, gold: np.ndarray, steps: int, batch: int = 64, rate: float = 0.01, seed: int = 2) -> float:
        """Adam over random batches; the last losses' mean."""
        rng = np.random.default_rng(seed)
        names = ("emb", "filters", "bias", "out", "out_bias")
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        mask, losses = self.mask(), []
        for step in range(1, steps + 1):
            at = rng.integers(0, len(windows), batch)
            own = windows[at]
            views = self._views(own)
            answers = (views.reshape(-1, views.shape[2]) @ self.filters).reshape(*views.shape[:2], -1)
            where = answers.argmax(axis=1)
            h = np.take_along_axis(answers, where[:, None, :], 1)[:, 0] + self.bias
            relu = np.maximum(h, 0)
            logp = _log_softmax(relu @ self.out + self.out_bias)
            losses.append(-float(logp[np.arange(batch), gold[at]].mean()))
            d = np.exp(logp)
            d[np.arange(batch), gold[at]] -= 1
            d /= batch
            dh = (d @ self.out.T) * (h > 0)
            patches = np.take_along_axis(views, where[:, :, None], 1)  # what each filter's largest answer saw
            grad = {"out": relu.T @ d, "out_bias": d.sum(axis=0), "bias": dh.sum(axis=0), "filters": np.einsum("bfk,bf->kf", patches, dh) * mask, "emb": np.zeros_like(self.emb)}
            spread = (dh[:, :, None] * self.filters.T[None]).reshape(batch, dh.shape[1], max(WIDTHS), SIZE)
            seen = np.take_along_axis(own[:, :, None], where[:, None, :] + np.arange(max(WIDTHS))[None, :, None], 1)
            np.add.at(grad["emb"], seen.transpose(0, 2, 1).ravel(), spread.reshape(-1, SIZE))
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                step_size = rate * (1 - 0.9 * step / steps)
                setattr(self, k, (getattr(self, k) - step_size * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32))
        return float(np.mean(losses[-20:])) if losses else 0.0


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row of each): WINDOW bytes each and the few next ones that the widest filter sees; bytes past a row's end are padding."""
    lengths = np.diff(offsets)
    counts = np.maximum(-(-lengths // WINDOW), 0)
    row = np.repeat(np.arange(len(lengths)), counts)
    first = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (offsets[:-1][row] + first * WINDOW)[:, None] + np.arange(WINDOW + max(WIDTHS) - 1)
    out = np.append(data, 0)[np.minimum(at, len(data))].astype(np.int32)
    out[at >= offsets[1:][row][:, None]] = 256
    return out, row


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


_DRAWN = pa.schema([("lang", pa.string()), ("h", pa.float64()), ("windows", pa.binary())])


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS_EACH windows of each text, drawn by a hash of the text, as the bytes of 16-bit numbers."""
    for batch in batches:
        drawn = []
        for first, data, offsets in text_chunks(batch.column("text")):
            windows, row = windows_of(data, offsets)
            begin = np.searchsorted(row, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                a, b = int(begin[i]), int(begin[i + 1])
                take = np.random.default_rng(zlib.crc32(data[offsets[i] : offsets[i + 1]])).permutation(b - a)[:WINDOWS_EACH]
                drawn.append(windows[a + take].astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(drawn, pa.binary())], schema=_DRAWN)


def learned(docs: DataFrame, sample: int, steps: int, most: int = 64_000, seed: int = 4) -> tuple[list[str], Network | None]:
    """The languages and the network; of the chosen documents the languages and windows reach the driver, and nothing else does."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy("lang").toPandas()
    labels = counts["lang"].tolist()
    if not labels:
        return [], None
    sample = max(1, min(sample, most // len(labels)))
    # about twice as many as asked for have hashes under this share of all; of them the smallest stay, those with one hash as one
    share = F.lit(0.0)
    for lang, n in zip(labels, counts["count"], strict=True):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * sample / n + 20.0 / n))).otherwise(share)
    few = known.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)).where(F.col("h") < share)
    few = few.select("lang", "h", "text").mapInArrow(_draw, "lang string, h double, windows binary").groupBy("lang", "h").agg(F.min("windows").alias("windows")).toPandas().sort_values(["lang", "h"])
    windows, gold = [], []
    for i, lang in enumerate(labels):
        for raw in few["windows"][few["lang"] == lang][:sample]:
            windows.append(np.frombuffer(raw, "<u2").reshape(-1, WINDOW + max(WIDTHS) - 1).astype(np.int32))
            gold += [i] * len(windows[-1])
    if not gold:
        return labels, None
    network = Network.new(len(labels))
    network.fit(np.concatenate(windows), np.array(gold), steps)
    return labels, network


def _predict(labels: list[str], network: Network | None):  # noqa: ANN202
    shape = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            if network is not None and batch.num_rows:
                total, count, letters = np.zeros((batch.num_rows, len(labels))), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
                for first, data, offsets in text_chunks(column):
                    rows = len(offsets) - 1
                    windows, row = windows_of(data, offsets)
                    found = np.concatenate([network.log_probabilities(windows[i : i + 128]) for i in range(0, len(windows), 128)] or [np.zeros((0, len(labels)), np.float32)])
                    for c in range(len(labels)):
                        total[first : first + rows, c] = np.bincount(row, found[:, c], rows)
                    count[first : first + rows] = np.bincount(row, minlength=rows)
                    hits = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offsets]
                    letters[first : first + rows] = hits[1:] > hits[:-1]
                for i in np.flatnonzero(~letters & (count > 0)):
                    letters[i] = any(map(str.isalpha, column[int(i)].as_py()))
                p = np.exp(_log_softmax(total / np.maximum(count, 1)[:, None]))
                at = p.argmax(axis=1)
                best, score = np.where(letters, at, -1), np.where(letters, p[np.arange(len(p)), at], 0.0)
            names = [labels[i] if i >= 0 else UNKNOWN for i in best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], schema=shape)

    return run


def predicted(docs: DataFrame, sample: int = 800, steps: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labels, network = learned(docs, sample, steps)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_predict(labels, network), "doc_id long, held_out boolean, lang_pred string, score double")
