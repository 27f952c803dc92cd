"""A Merkle manifest of a dataset: every row a leaf, a tree for each source, one over the sources, and a proof for each row.

Leaves of a source ascend by doc_id; every ``arity`` consecutive nodes of a level become their hash, level by level, until one is left
(a run of fewer nodes, even of one, is hashed too). Hashes are hex sha256 of hex texts joined.

A tree is cut into aligned blocks of ``arity ** depth`` leaves, so that a block's nodes are nodes of the whole tree. A task takes
a block and traverses it as a signer would: authentication paths advance leaf by leaf. A level keeps the siblings of the
current path alone; those it needs next grow in a treehash stack of that level, which takes as many leaves a step as keeps all
stacks in time, the stack with the lowest unfinished node first. So beside its leaves a task holds a number of nodes that grows with
the block's depth, not with its rows. The roots of the blocks are the leaves of the next tree up, traversed in blocks the same
way, and each row's path ends with the path of its block, which all rows of the block share.

Rows get their places by a range partition of (source, doc_id, leaf) and the counts of the partitions: no window holds a source, so one
with a third of all rows costs as much as many small ones. Text is read once; what is shuffled are hashes.

A proof is a list of levels from the leaf up: the hashes left and right of the node in its run, each joined. So a level's node
is the hash of left, the node below and right, and ``folded`` gives the root from any leaf and a proof.

Defined cases: each column may be null; a null source is a source of its own, the first; a null doc_id is the first of its source;
equal doc_ids follow in the order of their leaves, and rows equal in all fields are leaves of their own; an empty table has no rows (and no
root). Other columns are ignored but for those asked for in ``also``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

ARITY = 3
#: Levels of a block: 6,561 leaves, some MB of proofs.
DEPTH = 8
#: Rows of a partition of the sorted table, about.
PART_ROWS = 100_000
PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PROOF = "array<struct<left:string,right:string>>"


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Treehash:
    """The nodes of one level over the leaves from ``at`` up to ``end``, leaf by leaf; unfinished ones on a stack."""

    def __init__(self, level: int, at: int, end: int, arity: int) -> None:
        self.level, self.at, self.end, self.arity = level, min(at, end), end, arity
        self.stack: list[tuple[int, str]] = []  # (level, hash), levels falling; at most arity - 1 of each
        self.done: list[str] = []

    @property
    def tail(self) -> float:
        """The level of the lowest node; that of its first node to be, or none when all is done."""
        return math.inf if self.at == self.end else self.stack[-1][0] if self.stack else self.level

    def _put(self, level: int, node: str) -> None:
        if level == self.level:
            self.done.append(node)
            return
        self.stack.append((level, node))
        if len(self.stack) >= self.arity and self.stack[-self.arity][0] == level:
            self._close(level)

    def _close(self, level: int) -> None:
        """The run of this level at the stack's end becomes its parent."""
        run = []
        while self.stack and self.stack[-1][0] == level:
            run.append(self.stack.pop()[1])
        if run:
            self._put(level + 1, digest(run[::-1]))

    def push(self, leaves: list[str], last: bool) -> None:
        """One more leaf; after the tree's ``last`` one all runs close, whatever their length."""
        self._put(0, leaves[self.at])
        self.at += 1
        if last and self.at == self.end:
            for level in range(self.level):
                self._close(level)


def block_root(leaves: list[str], levels: int, arity: int = ARITY) -> str:
    """The node ``levels`` above these leaves, with a stack of a few nodes a level."""
    one = Treehash(levels, 0, len(leaves), arity)
    for _ in leaves:
        one.push(leaves, True)
    return one.done[0]


def paths(leaves: list[str], levels: int, arity: int = ARITY, peak: list[int] | None = None) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf in turn, the hashes left and right of its path on every level; ``peak`` takes the most nodes held at once."""
    n = len(leaves)
    width = [arity**h for h in range(levels + 1)]

    def group(level: int, number: int, first: int) -> Treehash:
        """The siblings of that run from the ``first`` on."""
        begin = number * width[level + 1]
        return Treehash(level, begin + first * width[level], min(n, begin + width[level + 1]), arity) if begin + first * width[level] < n else Treehash(level, n, n, arity)

    left: list[list[str]] = [[] for _ in range(levels)]
    right: list[list[str]] = []
    for h in range(levels):
        one = group(h, 0, 1)
        while one.at < one.end:
            one.push(leaves, one.end == n)
        right.append(one.done)
    coming = [group(h, 1, 1) for h in range(levels)]
    budget = -(-levels * (arity - 1) // arity)
    for s in range(n):
        yield ["".join(x) for x in left], ["".join(x) for x in right]
        if s + 1 == n:
            return
        for _ in range(budget):
            one = min(coming, key=lambda x: x.tail, default=None)  # the first of equals: the lowest level
            if one is None or one.at == one.end:
                break
            one.push(leaves, one.end == n)
        if peak is not None:
            peak.append(max(peak.pop() if peak else 0, sum(map(len, left)) + sum(map(len, right)) + sum(len(x.stack) + len(x.done) for x in coming)))
        # the levels whose node ends with this leaf go on to their next run, the one above them to its next node
        top = next(h for h in range(1, levels + 1) if (s + 1) % width[h]) - 1
        node = leaves[s]
        for h in range(top):
            node = digest([*left[h], node, *right[h]])
        for h in range(top):
            one = coming[h]
            while one.at < one.end:
                one.push(leaves, one.end == n)
            left[h], right[h] = [], one.done
            coming[h] = group(h, (s + 1) // width[h + 1] + 1, 1)
        left[top].append(node)
        right[top].pop(0)


def fields_hash(*columns: Column) -> Column:
    """The leaf of these columns: each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its text."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*(one(c.cast("string")) for c in columns)), 256)


def document_leaf(text: Column | str = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return fields_hash(F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text)


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0) in their tree by ``order``, and their tree's size; trees ascend."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    # within a sorted partition the upper 31 bits of this number are the partition, the lower 33 the row
    dealt = written(dealt.withColumn("number", F.monotonically_increasing_id()), f"{name}-sorted").withColumn("part", F.shiftright("number", 33))
    # a tree has a row for each partition here
    counts = written(dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("number").alias("first")), f"{name}-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", F.sum("n").over(Window.partitionBy("tree")).alias("size"), (before - F.col("first")).alias("shift"))
    return dealt.join(starts, ["tree", "part"]).withColumn("place", F.col("number") + F.col("shift")).drop("number", "part", "shift")


def _levels(size: int, arity: int, depth: int) -> int:
    """Levels of a block in a tree of this size: as many as the tree has, if it is the only block."""
    levels = 0
    while levels < depth and arity**levels < size:
        levels += 1
    return levels


def _roots(arity: int, depth: int):  # noqa: ANN202
    """A block's root, as a node of the next tree up."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        root = block_root(table.sort_by("place").column("node").to_pylist(), _levels(size, arity, depth), arity)
        return pa.table({"tree": table.column("tree")[:1], "place": table.column("block")[:1], "size": [-(-size // arity**depth)], "node": [root]})

    return run


def _paths(arity: int, depth: int, carried: list[str], shared: list[str]):  # noqa: ANN202
    """The rows of a block with their proofs: the path in the block, then the block's own; and what the block's rows share."""

    def run(table: pa.Table, block: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        levels = _levels(table.column("size")[0].as_py(), arity, depth)
        above = block.column("proof")[0].as_py()
        above_left, above_right = [x["left"] for x in above], [x["right"] for x in above]
        left, right = [], []
        for a, b in paths(table.column("node").to_pylist(), levels, arity):
            left += a + above_left
            right += b + above_right
        deep = levels + len(above)
        every = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
        proof = pa.ListArray.from_arrays(pa.array([deep * i for i in range(table.num_rows + 1)], pa.int32()), every)
        same = {c: pa.array(block.column(c).to_pylist() * table.num_rows, pa.string()) for c in shared}
        return pa.table({"tree": table.column("tree"), "node": table.column("node"), **{c: table.column(c) for c in carried}, **same, "proof": proof})

    return run


class Forest:
    """The trees over placed nodes (tree, place, size, node and columns to carry), in blocks."""

    def __init__(self, nodes: DataFrame, arity: int, depth: int, name: str) -> None:
        self.arity, self.depth, self.name = arity, depth, name
        self.levels, roots = [nodes], self._up(nodes)
        self.roots = roots.where("size = 1").select("tree", "node")
        while not roots.where("size > 1").isEmpty():
            self.levels.append(roots)
            roots = self._up(roots.where("size > 1"))
            self.roots = self.roots.unionByName(roots.where("size = 1").select("tree", "node"))
        self.levels.append(roots)

    def _blocks(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("block", F.floor(F.col("place") / F.lit(self.arity**self.depth)))

    def _up(self, nodes: DataFrame) -> DataFrame:
        """The roots of the blocks."""
        return written(self._blocks(nodes).groupBy("tree", "block").applyInArrow(_roots(self.arity, self.depth), "tree string, place long, size long, node string"), f"{self.name}-roots")

    def _proved(self, nodes: DataFrame, above: DataFrame, carried: list[str], shared: list[str]) -> DataFrame:
        """Proofs of nodes, from those of their blocks."""
        types = "".join(f"{c} {nodes.schema[c].dataType.simpleString()}, " for c in carried) + "".join(f"{c} string, " for c in shared)
        above = above.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_block"), "proof", *shared)
        return self._blocks(nodes).groupBy("tree", "block").cogroup(above.groupBy("up_tree", "up_block")).applyInArrow(_paths(self.arity, self.depth, carried, shared), f"tree string, node string, {types}proof {_PROOF}")

    def block_proofs(self) -> DataFrame:
        """(tree, place, proof) of the first blocks, up to their tree's root."""
        empty = F.array().cast(_PROOF)
        found = self.levels[-1].select("tree", "place", empty.alias("proof"))
        for level in reversed(self.levels[1:-1]):
            own = self._proved(level.where("size > 1").withColumn("at", F.col("place")), found, ["at"], [])
            done = level.where("size = 1").select("tree", "place", empty.alias("proof"))
            found = done.unionByName(own.select("tree", F.col("at").alias("place"), "proof"))
        return found

    def proofs(self, blocks: DataFrame, carried: list[str], shared: list[str]) -> DataFrame:
        """The first nodes with their proofs; ``blocks`` are their blocks' ones, with columns that all rows of a block share."""
        return self._proved(self.levels[0], blocks, carried, shared)


def manifest(docs: DataFrame, also: dict[str, Column] | None = None, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row, and the columns of ``also`` (expressions over the row)."""
    also = also or {}
    # sources as texts of which none is null, in the same order
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), document_leaf().alias("node"), F.col("doc_id").cast("long").alias("c0"), *(e.alias(f"c{i}") for i, e in enumerate(also.values(), 1)))
    carried = leaves.columns[2:]
    # a number keeps equal rows apart when they are dealt out; it is written, so that it stays when tasks are run again
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    own = Forest(written(placed(leaves, ["c0", "node", "tie"], "merkle").drop("tie"), "merkle-placed"), arity, depth, "merkle")
    # the sources' roots are the leaves of one more tree
    tops = written(placed(own.roots.select(F.lit("").alias("tree"), "node", F.col("tree").alias("source")), ["source"], "merkle-top"), "merkle-top-placed")
    top = Forest(tops, arity, depth, "merkle-top")
    over = top.proofs(top.block_proofs(), ["source"], []).select(F.col("source").alias("tree"), F.col("node").alias("subroot"), F.col("proof").alias("top_proof"))
    root = top.roots.first()
    blocks = own.block_proofs().join(over, "tree").select("tree", "place", F.concat("proof", "top_proof").alias("proof"), "subroot", F.lit(root and root["node"]).alias("root"))
    found = own.proofs(blocks, carried, ["subroot", "root"])
    return found.select(F.col("c0").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "proof", *(F.col(f"c{i}").alias(c) for i, c in enumerate(also, 1)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """The hash of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), ""), 256)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, source, doc_id, CAST(doc_id AS VARCHAR) AS s, replace(text, chr(10), '') AS less,
    concat('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS fields, text FROM documents
), c AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: CAST(ord(s[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) AS crc FROM d
), l AS (
  SELECT r, source, doc_id, sha256(fields || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(fields || CASE WHEN text IS NULL THEN '-' ELSE strlen(less) || ':' || less END) END AS tampered FROM c
), placed AS (
  SELECT *, coalesce('s' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l
), nodes AS (
  SELECT 0 AS level, tree, i, leaf AS h, n FROM placed
  UNION ALL SELECT level + 1, tree, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, tree, i // 3, n
), runs AS (
  SELECT level, tree, i // 3 AS g, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY 1, 2, 3
), tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS i, h, count(*) OVER () AS n, tree FROM nodes WHERE n = 1
), top_nodes AS (
  SELECT level, i, h, n FROM tops
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top_nodes WHERE n > 1 GROUP BY level, i // 3, n
), top_runs AS (
  SELECT level, i // 3 AS g, list(h ORDER BY i) AS hs FROM top_nodes WHERE n > 1 GROUP BY 1, 2
), walk AS (
  SELECT r, tree, 0 AS level, i, coalesce(tampered, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT w.r, w.tree, w.level + 1, w.i // 3, sha256(array_to_string(hs[1 : w.i % 3], '') || w.h || array_to_string(hs[w.i % 3 + 2 :], '')), w.proof || array_to_string(hs[1 : w.i % 3], '') || array_to_string(hs[w.i % 3 + 2 :], '')
  FROM walk w JOIN runs u ON u.level = w.level AND u.tree = w.tree AND u.g = w.i // 3
), ended AS (
  SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walk GROUP BY r
), rise AS (
  SELECT e.r, 0 AS level, t.i, e.h, e.proof FROM ended e JOIN placed p ON p.r = e.r JOIN tops t ON t.tree = p.tree
  UNION ALL
  SELECT w.r, w.level + 1, w.i // 3, sha256(array_to_string(hs[1 : w.i % 3], '') || w.h || array_to_string(hs[w.i % 3 + 2 :], '')), w.proof || array_to_string(hs[1 : w.i % 3], '') || array_to_string(hs[w.i % 3 + 2 :], '')
  FROM rise w JOIN top_runs u ON u.level = w.level AND u.g = w.i // 3
), risen AS (
  SELECT r, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM rise GROUP BY r
)
SELECT p.doc_id, p.leaf, t.h AS subroot, top.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = top.h AS verified
FROM placed p JOIN risen e ON e.r = p.r JOIN tops t ON t.tree = p.tree JOIN top_nodes top ON top.n = 1
"""
