"""N-gram Jaccard join with set-relation skipping.

Documents become sets of word shingles, each known by a 64-bit name (its length class and a 56-bit hash); two link when
100 * |x & y| >= percent * |x | y|. But for shingles of one name (odds of about 1e-17 for each two shingles), no link is lost or made up:

1. Equal sets are one set (their answers are the same), named by a 64-bit fingerprint. A second fingerprint is held against
   it: if two sets meet in the first alone, all are named anew by another seed.
2. Highly similar sets are found by bucketed minima; each is checked against a few representatives of its bucket, and
   those that link with one share its answers from then on: no pair inside such a group is looked at again.
   In an index list of over HUB_LEAST sets the same is done with HUBS of them, before any other pair of the list is looked at.
3. An inverted index holds the prefix of each set (frequent shingles last). Its lists are ordered by size and position and
   cut into blocks; a block is skipped when no set in it can be large enough, small enough or early enough, or when all of
   it already has the same answers. Parity bitmaps bound the difference of the pairs that are left.
4. What remains is checked on the whole sets; connected components of all links give each document its class.

Lists of over LIST_BLOCK sets are dealt out as pairs of blocks, so no list has to fit one task.

Defined cases: null, empty or blank text is an empty set, linked with nothing (its class is its own doc_id); fewer than k
words make one shingle; rows that repeat a doc_id are one node; a null doc_id stays, and never names a class unless all of
the class are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, components, mix, small_batches, span_hashes, text_chunks, text_only, window_hashes, word_spans, written

BINS, BANDS = 24, 6
#: Members of a bucket that the others are checked against.
REPRESENTATIVES = 4
SKETCH_BITS = 512
#: Shingles of which a task counts at a time, and how often one must occur among them to be reported as frequent.
COUNT_SLICE, COUNT_LEAST = 4_000_000, 2
#: Frequent shingles that are put last in the prefix order; any order is right, so the bound only limits the broadcast (4 MB).
HOT_MOST = 1 << 18
#: Seeds under which sets are named before giving up (each fails with odds of about n * n / 2^65).
SEEDS = 4
LIST_BLOCK = 2048
#: Sets of a list of over HUB_LEAST (or of a pair of blocks of it) that all others are checked against first.
HUBS, HUB_LEAST = 4, 16
#: Bits of the table that lets a pass over the text skip documents nobody asked for (2 MB broadcast); a false hit costs time only.
FILTER_BITS = 1 << 24
_BOUNDS = np.array([i * (1 << 64) // BINS for i in range(BINS)], np.uint64)


def shingle_sets(column: pa.Array, k: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle names) of each row; ``wanted`` masks rows.

    A name's first byte falls with the shingle's length in bytes and the rest is a hash, so names ascend from long shingles
    to short ones: long ones are made of rare words, and prefixes of them seldom meet by chance."""
    for first, data, offsets in text_chunks(column):
        rows = len(offsets) - 1
        if wanted is not None and not wanted[first : first + rows].any():
            continue
        data = _LOWER[data]
        starts, ends, at = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        sizes = np.concatenate([[0], np.cumsum(ends - starts)])
        grams = _named(window_hashes(words, k), sizes[k:] - sizes[:-k] if len(words) >= k else sizes[:0])
        for i in range(rows):
            if wanted is not None and not wanted[first + i]:
                continue
            a, b = at[i], at[i + 1]
            if b - a >= k:
                h = np.sort(grams[a : b - k + 1])
                yield first + i, h[np.concatenate([[True], h[1:] != h[:-1]])]
            elif b > a:
                yield first + i, _named(window_hashes(words[a:b], int(b - a)), sizes[b : b + 1] - sizes[a])
            else:
                yield first + i, np.zeros(0, np.uint64)


def _named(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (np.uint64(255) - np.minimum(size, 255).astype(np.uint64)) << np.uint64(56) | hashes >> np.uint64(8)


def set_name(h: np.ndarray, seed: int = 0) -> int:
    """The 64-bit fingerprint of a set of hashes (0: empty)."""
    return int(mix(np.array([mix(h ^ np.uint64(0xA5A5A5A5 + (seed << 32))).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).view(np.int64)[0]) if len(h) else 0


def parity_sketch(h: np.ndarray) -> bytes:
    return np.packbits((np.bincount((h & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys, each of BINS / BANDS bucket minima."""
    h = np.sort(mix(h))
    least = h[np.searchsorted(h, _BOUNDS) % len(h)].reshape(BANDS, -1)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(least.shape[1]):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + least[:, j])
    return key.view(np.int64)


def least_overlap(x, y, percent: int):  # noqa: ANN001, ANN201 - arrays or numbers
    """The least |x & y| of a link, from the sizes: 100 o >= percent (x + y - o)."""
    return -((-percent * (x + y)) // (100 + percent))


def _describe(k: int, seed: int):  # noqa: ANN202
    """Per row: size, fingerprint, second fingerprint, band keys and sketch; and, without a document, the shingles often met in a slice of the task's rows."""
    shape = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("check", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("hot", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch | None:
        if not held:
            return None
        u, c = np.unique(np.concatenate(held), return_counts=True)
        keep = c >= COUNT_LEAST
        none = [None]
        return pa.RecordBatch.from_arrays([pa.array(none, t.type) for t in list(shape)[:6]] + [pa.array([u[keep].view(np.int64)], shape.field("hot").type), pa.array([c[keep]], shape.field("times").type)], schema=shape) if keep.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0
        for batch in batches:
            n, fp, check, bands, sketch = [], [], [], [], []
            for _, h in shingle_sets(batch.column("text"), k):
                name = set_name(h, seed)
                check.append(set_name(h, ~seed & 0x7FFFFFFF))
                n.append(len(h))
                fp.append(name)
                bands.append(band_keys(h) if len(h) else None)
                sketch.append(parity_sketch(h) if len(h) else None)
                if len(h) and name not in seen:
                    seen.add(name)
                    held.append(h)
                    total += len(h)
                if total >= COUNT_SLICE:
                    if (out := frequent(held)) is not None:
                        yield out
                    held, seen, total = [], set(), 0
            none = pa.nulls(len(n), shape.field("hot").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(check, pa.int64()), pa.array(bands, shape.field("bands").type), pa.array(sketch, pa.binary()), none, none], schema=shape)
        if (out := frequent(held)) is not None:
            yield out

    return run


def _postings(k: int, percent: int, seed: int, hot):  # noqa: ANN202
    """(token, fp, n, pos) of each set's prefix; a set that a task meets again is left out."""
    shape = pa.schema([("token", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = hot.value
        seen: set[int] = set()
        for batch in batches:
            own: list[np.ndarray] = []
            names, sizes = [], []
            for _, h in shingle_sets(batch.column("text"), k):
                if not len(h) or (name := set_name(h, seed)) in seen:
                    continue
                seen.add(name)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                    often = tokens[at] == h
                    late = np.flatnonzero(often)
                    ordered = np.concatenate([h[~often], h[late[np.argsort(times[at[late]], kind="stable")]]])
                else:
                    ordered = h
                own.append(ordered[: len(h) + (-percent * len(h)) // 100 + 1])
                names.append(name)
                sizes.append(len(h))
            if own:
                c = np.array([len(x) for x in own])
                ends = np.cumsum(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), c)), pa.array(np.repeat(np.array(sizes, np.int32), c)), pa.array((np.arange(ends[-1]) - np.repeat(ends - c, c)).astype(np.int32))], schema=shape)

    return run


def _sets(k: int, seed: int, asked):  # noqa: ANN001, ANN202
    """(fp, items) of the documents that the filter table lets through."""
    shape = pa.schema([("fp", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = asked.value
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False)
            wanted = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            if wanted.any():
                got = [(set_name(h, seed), h.view(np.int64)) for _, h in shingle_sets(batch.column("text"), k, wanted)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([h for _, h in got], shape.field("items").type)], schema=shape)

    return run


def _slot(column: str):  # noqa: ANN202
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def sets_of(texts: DataFrame, reps: DataFrame, asked: DataFrame, k: int, seed: int) -> DataFrame:
    """(fp, items) of each fp in ``asked``; one more pass over the text, which works only on documents that may be asked for."""
    sc = texts.sparkSession.sparkContext
    marks = asked.join(reps, "fp").select(_slot("rep").alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 63))")).alias("m")).toPandas()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[marks["w"].to_numpy(np.int64)] = marks["m"].to_numpy(np.int64).view(np.uint64)
    found = texts.select("text", _slot("doc_id").alias("slot")).mapInArrow(_sets(k, seed, sc.broadcast(bits)), "fp long, items array<long>")
    return found.join(asked.distinct(), "fp", "left_semi").dropDuplicates(["fp"])


def _links(both: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of rows with both sets that link."""
    o = F.size(F.array_intersect("a_items", "b_items")).cast("long")
    return both.where((100 + percent) * o >= percent * (F.size("a_items") + F.size("b_items"))).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) that link, by their whole sets."""
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("items").alias(f"{x}_items"))
    return _links(pairs.join(side("a"), "a").join(side("b"), "b"), percent)


def list_pairs(fp: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, side: np.ndarray, sketch: np.ndarray, percent: int, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (indexes, and the bits they differ in at least) of one list that may link and whose answers aren't known: other class, size, position and bitmap allow it.

    ``side``: 2 meets all, 0 and 1 meet each other only (a pair of blocks of a longer list). Blocks are skipped whole."""
    order = np.lexsort((pos, n))
    fp, n, pos, comp, side, sketch = fp[order], n[order], pos[order], comp[order], side[order], sketch[order]
    left, right, bits = [], [], []
    edges = np.arange(0, len(n), block)
    least_pos = np.minimum.reduceat(pos, edges)
    rest_most = np.maximum.reduceat(n - pos, edges)
    comp_lo, comp_hi = np.minimum.reduceat(comp, edges), np.maximum.reduceat(comp, edges)
    lasts = np.minimum(edges + block, len(n))
    for i, (a, a_end) in enumerate(zip(edges, lasts, strict=True)):
        for j in range(i, len(edges)):
            b, b_end = edges[j], lasts[j]
            if percent * n[b] > 100 * n[a_end - 1]:
                break  # sizes ascend: all later blocks are too large for this one
            if comp_lo[i] == comp_hi[i] == comp_lo[j] == comp_hi[j]:
                continue
            if min(rest_most[i], rest_most[j]) < least_overlap(int(n[a]), int(n[b]), percent):
                continue
            x, y = np.meshgrid(np.arange(a, a_end), np.arange(b, b_end), indexing="ij")
            x, y = x.ravel(), y.ravel()
            keep = (y > x) & (comp[x] != comp[y]) & ((side[x] != side[y]) | (side[x] == 2)) & (percent * n[y] <= 100 * n[x])
            x, y = x[keep], y[keep]
            need = least_overlap(n[x].astype(np.int64), n[y].astype(np.int64), percent)
            keep = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
            x, y, need = x[keep], y[keep], need[keep]
            apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
            keep = apart <= n[x] + n[y] - 2 * need
            left.append(order[x[keep]])
            right.append(order[y[keep]])
            bits.append(apart[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), np.concatenate(bits)) if left else (none, none, none)


def _candidates(percent: int, nearest: bool, hubs: bool):  # noqa: ANN202
    """(token, a, b, more) from the lists of a sorted partition: pairs of sets that may link.

    ``hubs``: only pairs with one of HUBS sets of the list. ``nearest``: of the pairs that one list has between two classes only the one that differs in the fewest bits, and how
    many more there were; if it links, the others' answers are known."""
    shape = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("more", pa.int64())])
    keys = ("token", "lo", "hi")
    ends = ("i", "j", "apart")

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fp", "n", "pos", "comp", "side")}
        return got | {"sketch": np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, -1)}

    def short(x: dict[str, np.ndarray], run: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Lists of a few sets, all at once: each row with the s-th after it."""
        out = []
        s = 0
        while len(at) > (s := s + 1):
            i = np.flatnonzero(run[at[s:]] == run[at[:-s]])
            if not len(i):
                break
            i, j = at[i], at[i + s]
            n, m = x["n"][i].astype(np.int64), x["n"][j].astype(np.int64)
            need = least_overlap(n, m, percent)
            keep = (x["comp"][i] != x["comp"][j]) & (np.minimum(n - x["pos"][i], m - x["pos"][j]) >= need) & ((x["side"][i] != x["side"][j]) | (x["side"][i] == 2))
            i, j, room = i[keep], j[keep], (n + m - 2 * need)[keep]
            apart = np.bitwise_count(x["sketch"][i] ^ x["sketch"][j]).sum(axis=1, dtype=np.int64)
            keep = apart <= room
            out.append((i[keep], j[keep], apart[keep]))
        return out

    def with_hubs(x: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pairs of a list's hubs with all others that may link."""
        hub = at[np.argsort(mix(x["fp"][at].view(np.uint64)), kind="stable")[:HUBS]]
        i, j = np.repeat(hub, len(at)), np.tile(at, len(hub))
        n, m = x["n"][i].astype(np.int64), x["n"][j].astype(np.int64)
        need = least_overlap(n, m, percent)
        keep = (x["comp"][i] != x["comp"][j]) & (np.minimum(n - x["pos"][i], m - x["pos"][j]) >= need) & ((x["side"][i] != x["side"][j]) | (x["side"][i] == 2))
        i, j, room = i[keep], j[keep], (n + m - 2 * need)[keep]
        apart = np.bitwise_count(x["sketch"][i] ^ x["sketch"][j]).sum(axis=1, dtype=np.int64)
        return i[apart <= room], j[apart <= room], apart[apart <= room]

    def of(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The pairs of whole lists."""
        if not len(x["fp"]):
            return
        new = np.concatenate([[True], (x["token"][1:] != x["token"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])])
        run = np.cumsum(new)
        counts = np.bincount(run)
        if hubs:
            first = np.flatnonzero(new)
            for a, b in zip(first.tolist(), np.append(first[1:], len(run)).tolist(), strict=True):
                yield from told(x, run, [with_hubs(x, np.arange(a, b))])
            return
        yield from told(x, run, short(x, run, np.flatnonzero(counts[run] <= 64)))
        for r in np.flatnonzero(counts > 64):  # a long list's pairs are cut down before the next list's are made
            at = np.flatnonzero(run == r)
            i, j, apart = list_pairs(*(x[c][at] for c in ("fp", "n", "pos", "comp", "side", "sketch")), percent)
            yield from told(x, run, [(at[i], at[j], apart)])

    def told(x: dict[str, np.ndarray], run: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        p = dict(zip(ends, map(np.concatenate, zip(*found, strict=True)), strict=True)) if found else {}
        if not p or not len(p["i"]):
            return
        a, b = x["fp"][p["i"]], x["fp"][p["j"]]
        more = np.zeros(len(a), np.int64)
        if nearest:
            u, v = x["comp"][p["i"]], x["comp"][p["j"]]
            u, v = np.minimum(u, v), np.maximum(u, v)
            order = np.lexsort((b, a, p["apart"], v, u, run[p["i"]]))
            r, u, v = run[p["i"]][order], u[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
            more = np.diff(np.append(first, len(order))) - 1
            at = order[first]
            a, b, p = a[at], b[at], {c: y[at] for c, y in p.items()}
        keep = a != b
        yield pa.RecordBatch.from_arrays([pa.array(y[keep]) for y in (x["token"][p["i"]], np.minimum(a, b), np.maximum(a, b), more)], schema=shape)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = columns(batch)
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in x}
            last = (x["token"] == x["token"][-1]) & (x["lo"] == x["lo"][-1]) & (x["hi"] == x["hi"][-1])
            cut = int(np.argmax(last))  # the last list may go on in the next batch
            yield from of({c: v[:cut] for c, v in x.items()})
            held = {c: v[cut:] for c, v in x.items()}
        if held is not None:
            yield from of(held)

    return run_all


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(names, ascending, and counts) of the most frequent shingles: all from the least count that leaves at most HOT_MOST.

    That count follows from sums over classes of counts, so only the shingles chosen reach the driver."""
    counted = described.where("hot is not null").select(F.explode(F.arrays_zip("hot", "times")).alias("x")).groupBy(F.col("x.hot").alias("t")).agg(F.sum("x.times").alias("c")).where("c > 2")
    counted = written(counted.withColumn("class", F.floor(8 * F.log2("c"))), "jaccard-frequent")
    classes = counted.groupBy("class").agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("class")).collect()  # a row for each eighth of a power of two
    total, least = 0, None
    for row in classes:
        if (total := total + row["n"]) > HOT_MOST:
            break
        least = row["least"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hot = counted.where(F.col("c") >= least).select("t", "c").toPandas()
    tokens, times = hot["t"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], times[order]


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its class), fp (its set's name)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = text_only(docs)
    for seed in range(SEEDS):
        described = written(texts.mapInArrow(_describe(k, seed), "doc_id long, n long, fp long, check long, bands array<long>, sketch binary, hot array<long>, times array<long>"), "jaccard-sets")
        sets = described.where("fp is not null and n > 0").groupBy("fp").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("check").alias("check"), F.max("check").alias("other"))
        sets = written(sets, "jaccard-distinct")
        if sets.where("check <> other").isEmpty():
            break
    else:
        raise RuntimeError("sets met in their names under every seed")
    rows = described.where("fp is not null").select("doc_id", "n", "fp")
    tokens, times = _frequent(described)
    reps = sets.select("fp", "rep")

    # highly similar sets: each against the representatives of the largest bucket that it is in
    banded = sets.select("fp", F.explode("bands").alias("band"))
    picks = [F.min_by("fp", F.xxhash64("fp", F.lit(r))).alias(f"p{r}") for r in range(REPRESENTATIVES)]
    buckets = banded.groupBy("band").agg(F.count("*").alias("many"), *picks).where("many > 1")
    buckets = buckets.select("band", "many", F.array_distinct(F.array(*(f"p{r}" for r in range(REPRESENTATIVES)))).alias("reps"))
    near = banded.join(buckets.select("band", "many"), "band").groupBy("fp").agg(F.max_by("band", F.struct("many", "band")).alias("band"))
    near = written(near, "jaccard-near")
    chosen = written(buckets.join(near.select("band").distinct(), "band", "left_semi").select("band", F.explode("reps").alias("rep")), "jaccard-representatives")
    asked = near.select("fp").unionByName(chosen.select(F.col("rep").alias("fp"))).distinct()
    found = sets_of(texts, reps, asked, k, seed)
    member = found.join(near, "fp").select("band", F.col("fp").alias("a"), F.col("items").alias("a_items"))
    known = found.select(F.col("fp").alias("rep"), F.col("items").alias("b_items")).join(chosen, "rep").select("band", F.col("rep").alias("b"), "b_items")
    same = written(_links(member.join(known, "band").where("a <> b"), percent), "jaccard-same")
    classes = components(same, "jaccard-classes")

    # the index of prefixes, for what those links leave open
    posts = texts.mapInArrow(_postings(k, percent, seed, spark.sparkContext.broadcast((tokens, times))), "token long, fp long, n int, pos int")
    # lists are counted by partial sums and dealt out by their counts: no task takes a whole long list
    posts = written(posts, "jaccard-postings")
    lists = posts.groupBy("token").agg(F.min("fp").alias("first"), F.max("fp").alias("last"), F.count("*").alias("many")).where("first < last").select("token", "many")
    met = posts.join(lists, "token")
    dealt = met.join(sets.select("fp", "sketch"), "fp").withColumn("g", F.ceil(F.col("many") / LIST_BLOCK)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "n", "pos", side.alias("side"), "sketch", "many")
    dealt = written(_with_class(dealt, classes), "jaccard-lists")
    links = same

    def checked(lists: DataFrame, nearest: bool, hubs: bool = False) -> tuple[DataFrame, DataFrame]:
        """The pairs of the lists, and those of them that link."""
        placed = lists.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
        pairs = written(placed.mapInArrow(_candidates(percent, nearest, hubs), "token long, a long, b long, more long"), "jaccard-pairs")
        own = pairs.select("a", "b").distinct()
        asked = own.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        return pairs, written(linked(own, sets_of(texts, reps, asked, k, seed), percent), "jaccard-checked")

    long = dealt.where(F.col("many") > HUB_LEAST)
    if not long.isEmpty():
        # most sets of a long list are like one of a few: they share a class before pairs of classes are made
        links = links.unionByName(checked(long, nearest=True, hubs=True)[1])
        classes = components(links, "jaccard-classes")
        dealt = written(_with_class(dealt.drop("comp"), classes), "jaccard-lists")
    pairs, more = checked(dealt, nearest=True)
    links = links.unionByName(more)
    if not pairs.where("more > 0").isEmpty():
        # lists in which two classes have more pairs, and are still apart: now all of these
        classes = components(links, "jaccard-classes")
        left = _with_class(_with_class(pairs.where("more > 0"), classes, "a", "ca"), classes, "b", "cb").where("ca <> cb").select("token").distinct()
        rest = written(_with_class(dealt.join(left, "token", "left_semi").drop("comp"), classes), "jaccard-rest")
        if not rest.isEmpty():
            links = links.unionByName(checked(rest, nearest=False)[1])
    return _placed(rows, links)


def _with_class(df: DataFrame, classes: DataFrame, key: str = "fp", name: str = "comp") -> DataFrame:
    """``df`` with the class of its set (itself, if it has no links)."""
    own = classes.select(F.col("node").alias(key), F.col("root").alias("_root"))
    return df.join(own, key, "left").withColumn(name, F.coalesce("_root", key)).drop("_root")


def _placed(rows: DataFrame, links: DataFrame) -> DataFrame:
    repeated = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("doc_id", "a")
    links = links.unionByName(rows.where("n > 0").join(repeated, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b"))
    roots = components(links, "jaccard-links")
    placed = written(rows.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("class", F.coalesce("root", "fp")), "jaccard-placed")
    # written, so that the join below is one of two plain shuffles, whose hot classes Spark can split
    least = written(placed.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least")), "jaccard-least")
    alone = placed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "fp")
    return placed.where("n > 0").join(least, "class").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), "fp").unionByName(alone)
