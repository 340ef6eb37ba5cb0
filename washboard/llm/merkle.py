"""Merkle manifest of a dataset as a log of nodes in postorder.

The leaves of a tree, in order, are cut into aligned blocks. The builder of a block writes each node when its subtree is complete,
so a node stands behind its children and its place follows from numbers alone: before the leaf ``s`` stand the
``2 s - popcount(s)`` nodes of the complete subtrees to its left, and a subtree of ``c`` leaves and height ``h`` takes
``c + ceil(c/2) + ceil(c/4) + ..`` places, h + 1 terms, its root last. Roots of blocks are the leaves of the next level of builders,
up to a single block per tree; the roots of all trees are the leaves of one more tree.

Proofs go the other way: a block's row gets the siblings above its root from the level above and finds those below in its own
part of the log, by their places. No node is looked up by a join, and a leaf moves once, to its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washboard.llm.common import stage
from washboard.operators.lookup import BROADCAST_ROWS
from washboard.sources.row_index import by_order

#: A full block has 2 ** BLOCK_HEIGHT leaves.
BLOCK_HEIGHT = 11
DIGEST = 32


def digest(*parts: bytes) -> bytes:
    """Digest of digests, which are joined as lower-case hexadecimal text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def subtree_size(leaves: int, height: int) -> int:
    """Nodes of a tree of so many leaves and that height."""
    return sum(-(-leaves >> h) for h in range(height + 1))


def position(level: int, place: int, leaves: int) -> int:
    """Postorder position of the ``place``-th node of a level in a tree of ``leaves`` leaves."""
    first = place << level
    return 2 * first - first.bit_count() + subtree_size(min(1 << level, leaves - first), level) - 1


def height_of(leaves: int) -> int:
    return max(leaves - 1, 0).bit_length()


def append_log(leaves: list[bytes], height: int) -> bytes:
    """All nodes in order of completion. Each leaf completes the subtrees it is the last leaf of; the last one completes all."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(height + 1)]
    for i, leaf in enumerate(leaves):
        last, current, level = i == len(leaves) - 1, leaf, 0
        while True:
            log.append(current)
            run = waiting[level]
            run.append(current)
            if level == height or (len(run) == 1 and not last):
                break
            current, waiting[level] = digest(*run), []
            level += 1
    return b"".join(log)


def node(log: bytes, level: int, place: int, leaves: int) -> bytes:
    at = DIGEST * position(level, place, leaves)
    return log[at : at + DIGEST]


def nodes_of(log: bytes, leaves: int, height: int) -> list[list[bytes]]:
    """The nodes of each level, found by their positions."""
    return [[node(log, level, place, leaves) for place in range(-(-leaves >> level))] for level in range(height + 1)]


def siblings(nodes: list[list[bytes]], leaf: int) -> list[bytes]:
    """For each level below the root the sibling of the node above ``leaf`` behind a mark of its side: b"<" for a sibling on the left,
    b">" for one on the right; b"-" alone where there is none."""
    out = []
    for level, row in enumerate(nodes[:-1]):
        other = leaf >> level ^ 1
        out.append(b"-" if other >= len(row) else (b">" if other & 1 else b"<") + row[other])
    return out


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    for step in path:
        side, other = step[:1], step[1:]
        leaf = digest(leaf) if side == b"-" else digest(other, leaf) if side == b"<" else digest(leaf, other)
    return leaf


def packed(path: list[bytes]) -> bytes:
    return b"".join(step.ljust(1 + DIGEST, b"\0") for step in path)


def unpacked(path: bytes) -> list[bytes]:
    steps = (path[i : i + 1 + DIGEST] for i in range(0, len(path), 1 + DIGEST))
    return [step[:1] if step[:1] == b"-" else step for step in steps]


def field(value: Column) -> Column:
    """A value as text behind its length in bytes, or ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


@dataclass
class Manifest:
    """A dataset's trees. ``levels`` hold a row per block: tree, block, leaves, height, log (its nodes in postorder, 32 bytes each), ids,
    changed; level 0 has the dataset's leaves, each further level the roots of the blocks below. ``trees`` are (tree, leaves, number,
    root) and ``top`` the levels of the tree over their roots. Trees are named ``=`` and the value, or '' for null."""

    levels: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]
    block_height: int

    def roots(self) -> DataFrame:
        """(tree, leaves, subroot) of every tree."""
        return self.trees.select("tree", "leaves", hexadecimal("root").alias("subroot"))

    def root(self) -> DataFrame:
        """One row (root), none for an empty table."""
        return self.top[-1].select(hexadecimal(root_of("log")).alias("root"))

    def log(self, level: int = 0) -> DataFrame:
        """(tree, position, hash): the nodes of a level's blocks by their places in the postorder of the whole tree over that level's
        leaves, in which nodes above the blocks have places of their own."""
        start = F.shiftleft("block", self.block_height)
        count = (F.length("log") / DIGEST).cast("int")
        rows = self.levels[level].select("tree", "block", "log", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
        return rows.select("tree", (2 * start - F.bit_count(start) + F.col("i")).alias("position"), hexadecimal(F.substring("log", F.col("i") * DIGEST + 1, F.lit(DIGEST))).alias("hash"))


def hexadecimal(c) -> Column:
    return F.lower(F.hex(c))


def root_of(log: str) -> Column:
    """The last node of a log is its root."""
    return F.substring(log, -DIGEST, DIGEST)


BLOCK_ROW = "tree string, block bigint, leaves int, height int, log binary, ids array<bigint>, changed array<binary>"


def build_block(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """One block's row from its leaves (tree, block, place, total, leaf, id, changed); ``most`` is the height of a full block."""
    rows = rows.sort_values("place")
    height = min(most, height_of(int(rows["total"].iloc[0])))
    log = append_log([bytes(x) for x in rows["leaf"]], height)
    ids = [None if x is None else int(x) for x in rows["id"]]
    changed = [None if x is None else bytes(x) for x in rows["changed"]]
    one = {"tree": rows["tree"].iloc[0], "block": rows["block"].iloc[0], "leaves": len(rows), "height": height, "log": log}
    return pd.DataFrame([one | {"ids": ids, "changed": changed}])


def build_levels(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Levels of builders over ``leaves`` (tree, place, total, leaf, id: text, changed), up to a single block per tree.

    A level has a row for every block of the level below, so there are few levels."""
    levels = []
    while True:
        dealt = leaves.withColumn("block", F.shiftright("place", most))
        levels.append(stage(dealt.groupBy("tree", "block").applyInPandas(lambda rows: build_block(rows, most), BLOCK_ROW), "merkle-log"))
        if not levels[-1].filter("block > 0").limit(1).count():
            return levels
        per_tree = levels[-1].groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
        leaves = without_rows(levels[-1].join(per_tree, "tree").select("tree", F.col("block").alias("place"), "total", root_of("log").alias("leaf")))



def without_rows(leaves: DataFrame) -> DataFrame:
    """Leaves that stand for no row of the dataset."""
    return leaves.withColumns({"id": F.lit(None).cast("string"), "changed": F.lit(None).cast("binary")})


def build_manifest(
    docs: DataFrame, *, tree_col: str = "lang", id_col: str = "doc_id", leaf_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    changes: dict[str, Column] | None = None, block_height: int = BLOCK_HEIGHT,
) -> Manifest:
    """Trees of the rows of ``docs``, one for each value of ``tree_col`` and one over their roots.

    A leaf is the SHA-256 of the row's ``leaf_cols``, each as ``-`` where null, else its length in bytes, ``:`` and its text. In a tree
    leaves ascend by ``id_col`` (a whole number; null first, then by leaf); a node is the SHA-256 of its children's hexadecimal digests,
    where the last node of a level may be an only child. Trees ascend by the bytes of their value, null first. ``changes`` gives
    columns other values; the leaves that they alter are kept beside the true ones, to be proved against the trees.

    Rows that are repeated are leaves of their own. An empty table has no trees and no root. Columns not named are not looked at."""
    changed = [(changes or {}).get(c, F.col(c)) for c in leaf_cols]
    leaf, other = leaf_hash(*map(F.col, leaf_cols)), leaf_hash(*changed) if changes else F.lit(None).cast("string")
    altered = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(v) for c, v in (changes or {}).items()], F.lit(False))
    name = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    rows = docs.select(name.alias("tree"), F.col(id_col).cast("bigint").alias("id"), leaf.alias("leaf"), F.when(altered, other).alias("changed"),
                       F.monotonically_increasing_id().alias("salt"))
    rows = stage(rows, "merkle-leaves")
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("total"))
    # one row per tree
    in_order = Window.orderBy("tree")
    before = F.sum("total").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    sizes = stage(sizes.select(F.col("tree").alias("named"), "total", F.coalesce(before, F.lit(0)).alias("first"), (F.row_number().over(in_order) - 1).cast("bigint").alias("number")), "merkle-trees")
    n_trees = sizes.count()
    known = F.broadcast(sizes) if n_trees <= BROADCAST_ROWS else sizes
    # equal rows are told apart by the salt, so that no sort range holds more than its share of them
    placed = by_order(rows, "tree", F.col("id").asc_nulls_first(), "leaf", "changed", "salt", row="merkle_row")
    leaves = placed.join(known, F.col("tree") == F.col("named")).select(
        "tree", (F.col("merkle_row") - F.col("first")).alias("place"), "total", F.unhex("leaf").alias("leaf"), F.col("id").cast("string").alias("id"),
        F.unhex("changed").alias("changed"),
    )
    levels = build_levels(leaves, block_height)
    trees = levels[-1].join(known, F.col("tree") == F.col("named")).select("tree", F.col("total").alias("leaves"), "number", root_of("log").alias("root"))
    trees = stage(trees, "merkle-roots")
    top = trees.select(F.lit("all").alias("tree"), F.col("number").alias("place"), F.lit(n_trees).cast("bigint").alias("total"), F.col("root").alias("leaf"))
    return Manifest(levels, trees, build_levels(without_rows(top), block_height), block_height)


def paths(levels: list[DataFrame], above: DataFrame, block_height: int) -> DataFrame:
    """The blocks of the lowest level with the column ``path``: packed siblings from the block's root up.

    ``above``: (tree, path) of each tree's root."""
    known = levels[-1].join(above, "tree")
    for lower in reversed(levels[:-1]):
        below = known.select("tree", "block", "leaves", "height", "log", "path").mapInArrow(child_paths(block_height), "tree string, block bigint, path binary")
        known = lower.join(stage(below, "merkle-paths"), ["tree", "block"])
    return known


def child_paths(block_height: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The path of each leaf of a block, where the leaf is the root of a block below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                nodes = nodes_of(one["log"], one["leaves"], one["height"])
                found = [packed(siblings(nodes, i)) + one["path"] for i in range(one["leaves"])]
                places = [(one["block"] << block_height) + i for i in range(one["leaves"])]
                columns = [pa.array([one["tree"]] * len(found), pa.string()), pa.array(places, pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "block", "path"])

    return run


#: Leaves whose proofs are put together at once.
LEAVES_AT_ONCE = 512
PROOF = ["tree", "id", "leaf", "subroot", "path", "folded_root"]


def leaf_proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per leaf of the blocks given."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1).to_pylist()[0]
            nodes, outer = nodes_of(one["log"], one["leaves"], one["height"]), unpacked(one["path"])
            for start in range(0, one["leaves"], LEAVES_AT_ONCE):
                part = range(start, min(start + LEAVES_AT_ONCE, one["leaves"]))
                found = [siblings(nodes, i) + outer for i in part]
                folded = [fold(one["changed"][i] or nodes[0][i], path).hex() for i, path in zip(part, found)]
                texts = [[p[:1].decode() + p[1:].hex() for p in path] for path in found]
                columns = [[one["tree"]] * len(part), one["ids"][part.start : part.stop], [nodes[0][i].hex() for i in part], [one["subroot"]] * len(part), texts, folded]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], PROOF)


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, id, leaf, subroot, root, path, folded_root) of every leaf.

    ``path`` has for each level from the leaf to the root over all trees ``<`` or ``>`` and the digest of the sibling on that side, or
    ``-`` where there is none. ``folded_root`` is what the path makes of the leaf, or of the changed leaf where there is one."""
    start = manifest.top[-1].select("tree", F.lit(b"").alias("path"))
    top = paths(manifest.top, start, manifest.block_height).select("tree", "block", "leaves", "height", "log", "path")
    over = top.mapInArrow(child_paths(manifest.block_height), "tree string, block bigint, path binary").select(F.col("block").alias("number"), "path")
    above = manifest.trees.join(over, "number").select("tree", "path")
    roots = manifest.trees.select("tree", hexadecimal("root").alias("subroot"))
    known = paths(manifest.levels, stage(above, "merkle-paths"), manifest.block_height).join(roots, "tree")
    found = known.mapInArrow(leaf_proofs, "tree string, id bigint, leaf string, subroot string, path array<string>, folded_root string")
    root = manifest.root().first()
    return found.withColumn("root", F.lit(root["root"] if root else None).cast("string"))


def audit_columns() -> list[Column]:
    """A proof's digest, and whether it leads to the root."""
    others = F.transform(F.filter("path", lambda p: p != "-"), lambda p: F.substring(p, 2, 2 * DIGEST))
    return [F.sha2(F.concat_ws("", others), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]
