"""Operator 11, a Merkle manifest of a dataset by traversal scheduling.

A row's leaf is the digest of its fields, each with its length, so no two rows that differ share one. Leaves of a group ascend by id;
every 8 consecutive nodes become their digest until one, the subroot, remains; subroots become the root in the same manner.

Leaves are numbered by a range sort and distributed prefix counts, and cut into aligned blocks of 8^4. A block is one row with its
digests. Roots of blocks are the leaves of the next level of blocks, so all but the lowest level together are a 4096th of the rows.
Then paths come down: an upper block gives each of its nodes its authentication path, once for all that lies below, and within a block
the path of each leaf follows from that of the leaf before it. At each level a treehash stack builds the next run of siblings, one
leaf at a step, so that it is complete just when it is needed; a task holds a block's digests, a run a level and the stacks, which grow
with the logarithm of the block. No text is moved, only digests.

Nulls and edge cases: a null field has a mark of its own; null ids come first in a group, and rows of one id are ordered by their
digests; rows that repeat whole are leaves each; a null group is a group, the first; a group of one row is its leaf. An empty table
gives an empty result. Texts are hashed whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, shuffle_partitions

ARITY, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before:binary,after:binary>>"
_ARROW_PATH = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
#: Digests in tasks are hexadecimal text, as they are hashed; in tables they are bytes.
Path = list[tuple[bytes, bytes]]


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row, in bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def digest(nodes: Sequence[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """Builds runs of nodes of one level from leaves that are read one at a time."""

    def __init__(self, leaves: Sequence[bytes], level: int, at: int = 0):
        self.leaves, self.at, self.span = leaves, at, ARITY ** (level + 1)
        self.partial: list[list[bytes]] = [[] for _ in range(level)]
        self.run: list[bytes] = []

    def read(self) -> None:
        if self.at == len(self.leaves):
            return
        node = self.leaves[self.at]
        self.at += 1
        last = self.at == len(self.leaves)
        for part in self.partial:
            part.append(node)
            if len(part) < ARITY and not last:
                return
            node = digest(part)
            part.clear()
        self.run.append(node)

    def next_run(self) -> list[bytes]:
        """The run that is complete, which is built no further."""
        run, self.run = self.run, []
        return run


class Traversal:
    """Authentication paths of a block's leaves, in order: for each level the nodes before and after the leaf's own."""

    def __init__(self, leaves: Sequence[bytes], levels: int):
        self.leaves = leaves
        self.stacks = [Treehash(leaves, level) for level in range(levels)]
        self.runs: list[list[bytes]] = []
        for stack in self.stacks:
            for _ in range(min(stack.span, len(leaves))):
                stack.read()
            self.runs.append(stack.next_run())
        self.root = digest(self.runs[-1]) if levels else leaves[0]

    def paths(self) -> Iterator[Path]:
        for i in range(len(self.leaves)):
            path, below = [], i
            for level, stack in enumerate(self.stacks):
                if i and i % stack.span == 0:
                    self.runs[level] = stack.next_run()
                stack.read()
                own = below % ARITY
                below //= ARITY
                run = self.runs[level]
                path.append((b"".join(run[:own]), b"".join(run[own + 1 :])))
            yield path


def folded(node: bytes, path: Path) -> bytes:
    """What ``node`` and its siblings lead up to."""
    for before, after in path:
        node = digest((before, node, after))
    return node


def _read(path: list | None) -> Path:
    return [(x["before"].hex().encode(), x["after"].hex().encode()) for x in path or ()]


def _stored(path: Path) -> list[dict]:
    return [{"before": bytes.fromhex(a.decode()), "after": bytes.fromhex(b.decode())} for a, b in path]


def _hex(nodes: list[bytes]) -> list[bytes]:
    return [x.hex().encode() for x in nodes]


def _levels(n: int, levels: int) -> int:
    """Levels within a block of at most ``levels``, of a tree of ``n`` nodes: all there are if it is the only one."""
    return height(n) if n <= ARITY**levels else levels


def _roots(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """tree, block, n, nodes -> tree, block, n, root. One pass over a block, with a stack of partial runs."""
    for batch in batches:
        roots = []
        for n, nodes in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            stack = Treehash(_hex(nodes.as_py()), _levels(n, levels))
            for _ in stack.leaves:
                stack.read()
            roots.append(bytes.fromhex(stack.run[0].decode()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], ["tree", "block", "n", "root"])


def _node_paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """tree, block, n, nodes, up -> tree, idx, path of each node of an upper block."""
    for batch in batches:
        for tree, block, n, nodes, up in zip(*batch.columns, strict=True):
            rest = _read(up.as_py())
            walk = Traversal(_hex(nodes.as_py()), _levels(n.as_py(), levels))
            paths = [_stored(p + rest) for p in walk.paths()]
            first = block.as_py() * ARITY**levels
            yield pa.RecordBatch.from_arrays([pa.array([tree.as_py()] * len(paths), pa.string()), pa.array(range(first, first + len(paths)), pa.int64()), pa.array(paths, _ARROW_PATH)], ["tree", "idx", "path"])


def numbered(nodes: DataFrame, order: list[str], ws: Workspace, name: str) -> DataFrame:
    """``nodes`` with their number ``idx`` in their tree, from 0, and the tree's number of nodes ``n``.

    Rows are sorted by range, so that a large tree is parted; what is summed up over partitions is a row for each tree in each.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = shuffle_partitions(ws.spark)
    dealt = ws.save(nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).select("*", F.spark_partition_id().alias("part"), inside.alias("at")), f"{name}-sorted")
    counts = dealt.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("part", "tree", (before - F.col("first")).alias("shift"), F.sum("c").over(tree).alias("n"))
    return dealt.join(places, ["part", "tree"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


class Forest:
    """Blocks of trees, level by level. ``nodes``: tree, idx, n, digest, and what else is kept of the leaves."""

    def __init__(self, nodes: DataFrame, ws: Workspace, name: str, levels: int, keep: tuple[str, ...] = ()):
        self.ws, self.name, self.levels, self.size = ws, name, levels, ARITY**levels
        self.blocks = [self._blocked(nodes, 0, keep)]
        most = self.blocks[0].agg(F.max("n")).first()[0] or 0
        self.roots = None
        while True:
            level = len(self.blocks)
            roots = ws.save(self.blocks[-1].select("tree", "block", "n", F.col("nodes.digest").alias("nodes")).mapInArrow(partial(_roots, levels=self.levels), "tree string, block long, n long, root binary"), f"{name}-roots-{level}")
            done = roots.where(f"n <= {self.size}").select("tree", F.col("root").alias("digest"))
            #: tree, digest: the root of each tree.
            self.roots = self.roots.unionByName(done) if self.roots else done
            if most <= self.size:
                return
            most = -(-most // self.size)
            above = roots.where(f"n > {self.size}").select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / self.size).cast("long").alias("n"), F.col("root").alias("digest"))
            self.blocks.append(self._blocked(above, level))

    def _blocked(self, nodes: DataFrame, level: int, keep: tuple[str, ...] = ()) -> DataFrame:
        node = F.struct("idx", "digest", *keep)
        blocks = nodes.groupBy("tree", F.floor(F.col("idx") / self.size).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node)).alias("nodes"))
        return self.ws.save(blocks, f"{self.name}-blocks-{level}")

    def paths(self) -> DataFrame | None:
        """tree, idx, path of the roots of the lowest blocks; None if no tree has several."""
        found = None
        for level, blocks in reversed(list(enumerate(self.blocks[1:], 1))):
            blocks = with_path(blocks.select("tree", "block", "n", F.col("nodes.digest").alias("nodes")), found)
            found = self.ws.save(blocks.select("tree", "block", "n", "nodes", "up").mapInArrow(partial(_node_paths, levels=self.levels), f"tree string, idx long, path {_PATH}"), f"{self.name}-paths-{level}")
        return found


def with_path(blocks: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``blocks`` with the path ``up`` from their roots; those of a tree's only block have none."""
    if paths is None:
        return blocks.withColumn("up", F.lit(None).cast(_PATH))
    return blocks.join(paths.select("tree", F.col("idx").alias("block"), F.col("path").alias("up")), ["tree", "block"], "left")


def _proofs(batches: Iterator[pa.RecordBatch], kind: pa.DataType, levels: int, with_paths: bool) -> Iterator[pa.RecordBatch]:
    """A row a leaf of blocks: n, ids, leaves, other leaves, path from the block, path from the tree, subroot, root."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "path"]
    for batch in batches:
        for n, ids, leaves, changed, up, over, subroot, root in zip(*batch.columns, strict=True):
            nodes = _hex(leaves.as_py())
            rest = _read(up.as_py()) + _read(over.as_py())
            shared = b"".join(a + b for a, b in rest)
            proofs, found, paths = [], [], []
            for node, other, path in zip(nodes, changed.as_py(), Traversal(nodes, _levels(n.as_py(), levels)).paths(), strict=True):
                proofs.append(sha256(b"".join(a + b for a, b in path) + shared).hexdigest())
                found.append(folded(folded(other.hex().encode() if other else node, path), rest).decode())
                paths.append(_stored(path + rest) if with_paths else None)
            same = lambda digest: pa.array([digest.as_py().hex()] * len(nodes), pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), kind), pa.array([x.decode() for x in nodes], pa.string()), same(subroot), same(root), pa.array(proofs, pa.string()), pa.array(found, pa.string()), pa.array(paths, _ARROW_PATH)], names)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None, with_paths: bool = False, levels: int = LEVELS) -> DataFrame:
    """A row a document: its id under the name of ``id_col``, leaf, subroot, root, proof_sha256 (the digest of its siblings), folded_root, verified, and its path, if asked.

    ``folded_root`` is what the siblings lead up to from the row as it is, or, ``where`` that is true, with the fields that ``changed`` replaces;
    so it is the root only of rows that are what they were.
    """
    ws = Workspace(docs.sparkSession, "merkle")
    kind = docs.schema[id_col].dataType
    own = [F.col(c) for c in fields]
    other = leaf([(changed or {}).get(c, F.col(c)) for c in fields])
    altered = F.when(where, other) if where is not None else F.lit(None).cast("binary")
    tree = F.when(F.col(group_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf(own).alias("digest"), altered.alias("changed"))
    forest = Forest(numbered(leaves, ["id", "digest", "changed"], ws, "leaves"), ws, "leaves", levels, ("id", "changed"))
    subroots = numbered(forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest"), ["id"], ws, "subroots")
    top = Forest(subroots, ws, "subroots", levels, ("id",))

    # from the top down: subroots get their paths to the root, and blocks theirs to the subroot
    whole = with_path(top.blocks[0].select("tree", "block", "n", F.col("nodes.digest").alias("nodes"), F.col("nodes.id").alias("ids")), top.paths())
    over = ws.save(whole.select("tree", "block", "n", "nodes", "up").mapInArrow(partial(_node_paths, levels=levels), f"tree string, idx long, path {_PATH}"), "over")
    named = top.blocks[0].select(F.inline("nodes")).select("idx", F.col("id").alias("tree"), F.col("digest").alias("subroot"))
    root = top.roots.first()
    over = named.join(over.select("idx", F.col("path").alias("over")), "idx").select("tree", "subroot", "over", F.lit(bytes(root.digest) if root else None).cast("binary").alias("root"))
    lowest = forest.blocks[0].select("tree", "block", "n", F.col("nodes.id").alias("ids"), F.col("nodes.digest").alias("leaves"), F.col("nodes.changed").alias("changed"))
    blocks = with_path(lowest, forest.paths()).join(over, "tree")

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    out = blocks.select("n", "ids", "leaves", "changed", "up", "over", "subroot", "root").mapInArrow(lambda b: _proofs(b, arrow_kind, levels, with_paths), f"id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, path {_PATH}")
    found = out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), *(["path"] if with_paths else []))
    return found


def tampered(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``documents``, with every third of them, by the checksum of its id, held against it with its text in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, changed={"text": F.translate("text", upper, upper.lower())}, where=third, levels=levels)
