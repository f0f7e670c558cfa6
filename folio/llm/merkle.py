"""A Merkle manifest of a dataset: a hash tree over each source's documents, and one over the sources.

Trees are ternary. A tree's leaves are dealt into aligned blocks of 3^6, whose roots are the leaves of the next tier, until
one node is left. Within a block a fractal traversal emits one leaf's authentication path after another: for each pair
of levels it keeps the existing subtree, which holds the siblings at hand, and builds the desired subtree, which
comes next, one leaf at each step; so it holds the digests of one block and a few dozen nodes. The paths of block
roots come as the first row of each block and are appended to those of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Nodes of a run, levels of a stacked subtree, and how many of these a block stacks.
ARITY, SUBTREE, STACK = 3, 2, 3
LEVELS = SUBTREE * STACK
BLOCK = ARITY**LEVELS
#: Rows that a task hands on at once.
ROWS = 2000
STEPS = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of its inputs' concatenation."""
    return F.sha2(F.concat(*[p.cast("string") for p in parts]).cast("binary"), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """A document's digest: each field with its length in bytes before it, so that fields can't run into each other; ``-`` for null."""
    return digest(*map(_field, (doc_id, source, lang, n_chars, text)))


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class _Growing:
    """A subtree that grows from its leaves' leaves: nodes of ``SUBTREE`` levels are kept, those below only until a run of them is full."""

    def __init__(self, stacked: int, first: int, count: int):
        self.low, self.high = SUBTREE * stacked, SUBTREE * (stacked + 1)
        self.first, self.end = first, min(count, first + ARITY**self.high)
        self.at, self.tails = first, [[] for _ in range(self.high + 1)]
        self.nodes: dict[tuple[int, int], str] = {}

    def step(self, leaves: list[str]) -> None:
        """Take the next leaf; the last one closes the runs that are not full."""
        if self.at >= self.end:
            return
        self._put(0, self.at, leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for level in range(self.high):
                if self.tails[level]:
                    self._close(level, (self.at - 1) // ARITY ** (level + 1))

    def _put(self, level: int, place: int, node: str) -> None:
        if self.low <= level < self.high:
            self.nodes[level, place] = node
        if level < self.high:
            self.tails[level].append(node)
            if len(self.tails[level]) == ARITY:
                self._close(level, place // ARITY)

    def _close(self, level: int, place: int) -> None:
        node, self.tails[level] = _hash(self.tails[level]), []
        if level + 1 == self.high:
            self.root = node
        self._put(level + 1, place, node)

    def grown(self, leaves: list[str]) -> _Growing:
        while self.at < self.end:
            self.step(leaves)
        return self


def tree_root(leaves: list[str], levels: int) -> str:
    """The node ``levels`` above a block's leaves; a single one goes up alone."""
    nodes = leaves
    for _ in range(levels):
        nodes = [_hash(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
    return nodes[0]


def levels_of(count: int) -> int:
    """Levels above ``count`` nodes until one remains."""
    levels = 0
    while count > 1:
        count, levels = -(-count // ARITY), levels + 1
    return levels


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For one leaf after another of a block, its siblings on ``levels`` levels: what stands before and after the node.

    Each stacked subtree moves on when the leaf leaves it: the desired one, which took a leaf at each step, becomes the
    existing one, and the next is begun.
    """
    count, stacks = len(leaves), range(-(-levels // SUBTREE))
    exist = [_Growing(s, 0, count).grown(leaves) for s in stacks]
    desired = [_Growing(s, exist[s].end, count) for s in stacks]
    for at in range(count):
        for s in stacks:
            if at == exist[s].end:
                exist[s] = desired[s].grown(leaves)
                desired[s] = _Growing(s, exist[s].end, count)
        path = []
        for level in range(levels):
            nodes, place = exist[level // SUBTREE].nodes, at // ARITY**level
            run = place - place % ARITY
            path.append(("".join(nodes[level, i] for i in range(run, place)), "".join(nodes.get((level, i), "") for i in range(place + 1, run + ARITY))))
        yield path
        for s in stacks:
            desired[s].step(leaves)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """The rows of one block after another of a sorted partition: the first row, and the others."""
    key, head, rows = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["block"]) != key:
                if rows:
                    yield head, rows
                key, head, rows = (row["tree"], row["block"]), None, []
            if row["place"] < 0:
                head = row
            else:
                rows.append(row)
    if rows:
        yield head, rows


def _levels(row: dict) -> int:
    """Levels within a block: all, unless the block is the whole tree."""
    return levels_of(row["size"]) if row["size"] <= BLOCK else LEVELS


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = []
    for _, rows in _blocks(batches):
        size = -(-rows[0]["size"] // BLOCK)
        done.append({"tree": rows[0]["tree"], "place": rows[0]["block"], "size": size, "node": tree_root([r["node"] for r in rows], _levels(rows[0]))})
        if len(done) == ROWS:
            yield _batch(done, NODES)
            done = []
    yield _batch(done, NODES)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = []
    for head, rows in _blocks(batches):
        above = [(s["before"], s["after"]) for s in head["above"]]
        for row, path in zip(rows, traverse([r["node"] for r in rows], _levels(rows[0])), strict=True):
            steps = [{"before": b, "after": a} for b, a in path + above]
            done.append({k: row[k] for k in ("tree", "place", "node", "id", "tampered")} | {"subroot": head["subroot"], "root": head["root"], "proof": steps})
            if len(done) == ROWS:
                yield _batch(done, PATHS)
                done = []
    yield _batch(done, PATHS)


NODES = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("size", pa.int64()), ("node", pa.string())])
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
PATHS = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("node", pa.string()), ("id", pa.int64()), ("tampered", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", _STEPS)])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """Each block together in one task, in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {BLOCK}"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place``, from 0 in each ``tree`` in the given order, and ``size``, the number of the tree's nodes.

    Rows are dealt into ranges of tree and order, so a tree of any size is spread over tasks. Each range numbers its
    rows, and a tree goes on from the counts of the ranges before, of which there is a row for each range and tree.
    Rows that are alike in all of the order are interchangeable; their number in the table spreads them.
    """
    spread = nodes.withColumn("_spread", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("tree", *order, "_spread").sortWithinPartitions("tree", *order, "_spread").drop("_spread")
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranges")
    counted = ranged.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own, earlier = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("_range")
    counted = counted.select("tree", "_range", (F.sum("_n").over(earlier) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("size"))
    out = ranged.join(materialize(counted, "range-counts"), ["tree", "_range"])
    return out.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of nodes (tree, place, size, node), and the single node of each tree."""
    tiers, tops = [nodes], None
    while True:
        given = _dealt(_in_blocks(tiers[-1]).select("tree", "block", "place", "size", "node"))
        made = materialize(given.mapInArrow(_roots, "tree string, place long, size long, node string"), "block-roots")
        top = made.where("size = 1").select("tree", "node")
        tops = top if tops is None else tops.unionByName(top)
        rest = made.where("size > 1")
        if not rest.limit(1).count():
            return tiers, tops
        tiers.append(rest)


def _descend(tiers: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The paths of all nodes of the lowest tier. ``heads`` has tree, subroot, root and above (steps) for each tree."""
    upper = None
    for number, nodes in reversed([*enumerate(tiers)]):
        nodes = _in_blocks(nodes)
        for name, kind in (("id", "long"), ("tampered", "string")):
            if name not in nodes.columns:
                nodes = nodes.withColumn(name, F.lit(None).cast(kind))
        # A tree whose nodes fill one block gets its head from the tree above, others from the tier above.
        first = nodes.where(f"place = 0 and size <= {BLOCK}").select("tree", F.lit(0).cast("long").alias("block")).join(heads, "tree")
        if upper is not None:
            first = first.unionByName(upper.select("tree", F.col("place").alias("block"), "subroot", "root", F.col("proof").alias("above")))
        first = first.withColumn("place", F.lit(-1).cast("long"))
        given = _dealt(nodes.select("tree", "block", "place", "size", "node", "id", "tampered").unionByName(first, allowMissingColumns=True))
        upper = given.mapInArrow(_paths, f"tree string, place long, node string, id long, tampered string, subroot string, root string, proof {STEPS}")
        if number:
            upper = materialize(upper, "upper-paths")
    return upper


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """For each document its leaf, its source's ``subroot``, the dataset's ``root`` and its ``proof``, the siblings level by level.

    Rows: doc_id, source, place (in its source, from 0), leaf, tampered (the digest of the altered document where the
    text ``tampered`` isn't null, else null), subroot, root, proof (for each level what stands before and after the
    node; both empty where a node goes up alone). A source's leaves ascend by doc_id, nulls first, then by digest; null is
    a source of its own, before all others. A tree of one leaf is that leaf. Repeated rows are leaves each, with
    neighbouring places. Texts of any length are hashed whole where they are read. An empty table gives no rows. Columns
    other than doc_id, source, lang, n_chars and text play no part.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source"))
    altered = F.when(tampered.isNotNull(), leaf_of(*own[:4], tampered)) if tampered is not None else F.lit(None).cast("string")
    leaves = materialize(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_of(*own).alias("node"), altered.alias("tampered")), "leaves")
    nodes = materialize(placed(leaves, ["id", "node"]), "placed")
    release(leaves)
    tiers, subroots = _climb(nodes)
    sources = materialize(placed(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("own"), "node"), ["own"]), "subroots")
    above, roots = _climb(sources.drop("own"))
    whole = roots.select("tree", F.col("node").alias("subroot"), F.col("node").alias("root"), F.expr(f"CAST(array() AS {STEPS})").alias("above"))
    paths = _descend(above, whole).select("place", "root", F.col("proof").alias("above"))
    heads = materialize(sources.join(paths, "place").select(F.col("own").alias("tree"), F.col("node").alias("subroot"), "root", "above"), "heads")
    found = _descend(tiers, heads)
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))
    return found.select(F.col("id").alias("doc_id"), source.alias("source"), "place", F.col("node").alias("leaf"), "tampered", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof in one text, from the leaf's level upwards."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")
