import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyline.llm import merkle_manifest as merkle
from tallyline.llm import queries

sha = lambda x: sha256(x.encode()).hexdigest()


def tree(leaves, arity=3):
    """All levels of a tree, and the siblings of each leaf, level by level: (left, right) of its run."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[i : i + arity])) for i in range(0, len(row), arity)])
    proofs = []
    for i in range(len(leaves)):
        proof = []
        for row in levels[:-1]:
            first = i - i % arity
            proof.append(("".join(row[first:i]), "".join(row[i + 1 : first + arity])))
            i //= arity
        proofs.append(proof)
    return levels[-1][0], proofs


@pytest.mark.parametrize("arity", [2, 3, 4])
def test_traversal_gives_every_path(arity):
    for n in [*range(1, 60), 81, 82, 200, 243]:
        leaves = [sha(str(i)) for i in range(n)]
        root, proofs = tree(leaves, arity)
        levels = next(h for h in range(20) if arity**h >= n)
        assert merkle.block_root(leaves, levels, arity) == root
        assert [list(zip(a, b, strict=True)) for a, b in merkle.paths(leaves, levels, arity)] == proofs


def test_traversal_holds_few_nodes():
    """Beside the leaves, a number of nodes that grows with the depth: 4 for each of 8 levels, of 9,841 that the tree has."""
    peaks = {}
    for levels in (4, 6, 8):
        peak = []
        for _ in merkle.paths([f"{i:064x}" for i in range(3**levels)], levels, peak=peak):
            pass
        peaks[levels] = peak[0]
    assert all(p <= 6 * levels for levels, p in peaks.items())


def brute(rows):
    """The contract's words over (doc_id, source, lang, n_chars, text), row by row."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    trees = {}
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = own, *tree([leaf(r) for r in own])
    root, tops = tree([t[1] for t in trees.values()])
    out = []
    for (own, subroot, proofs), top in zip(trees.values(), tops, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((*r[:4], r[4] and r[4].replace("\n", ""))) if odd else leaf(r)
            for a, b in proof + top:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in proof + top)), node, node == root))
    return sorted(out, key=str)


def _fields(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_query_by_brute_force(spark, tmp_path, docs):
    """Null, empty and very long texts, repeated rows and ids, null sources; some texts change when their line ends go, some don't."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_merkle_manifest"](spark, str(tmp_path))
    rows = sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)
    assert rows == brute(_fields(docs)) and {r[-1] for r in rows} == {True, False}


def test_blocks_over_several_levels(spark, monkeypatch):
    """A source of 500 rows in blocks of 9 (three levels of blocks), others of 1, 9, 10 and 82, more sources than a block holds; rows over many partitions."""
    monkeypatch.setattr(merkle, "PART_ROWS", 40)
    sizes = {"hot": 500, "one": 1, "nine": 9, "ten": 10, None: 82, "": 3, "é": 2, **{f"s{i}": 1 + i % 3 for i in range(12)}}
    rows = [(1000 * k + i // (2 if k == 0 else 1), s, "en", i, f"{s} {i}\n") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    found = merkle.manifest(df, {"also": F.length("text")}, depth=2)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof", "also"]
    got = {(r.doc_id, r.leaf, r.subroot, r.root, sha("".join(x.left + x.right for x in r.proof))) for r in found.collect()}
    assert got == {r[:5] for r in brute(rows)}
    ends = found.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).groupBy("ok").count().collect()
    assert [tuple(r) for r in ends] == [(True, len(rows))]


def test_nothing_gives_nothing(none):
    assert merkle.manifest(none).collect() == []
