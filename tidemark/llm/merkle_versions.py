"""Merkle manifest of a table as a persistent tree, distributed by aligned blocks.

Leaves are the rows of a group (a language) in order; two neighbours make a node
of the level above, the last node of an odd level makes one by itself, until one
is left.  The groups' roots, in order, are the leaves of one more such tree.

The tree is stored in aligned blocks of 2^12 leaves: a block is a whole subtree,
built in one task.  Its roots are the leaves of the next storey, built likewise,
and so on; a storey is 4096 times smaller than the one below.  A tampered leaf
makes a version: Tree.changed() copies the leaf's ancestors and nothing else, all
other nodes belong to both versions.  A version leaves its block as the copied
block root and goes on through the storeys above, where for each block it copies
the ancestors between the shared nodes beside them (the block's path).  Thousands
of versions of one table take thousands of paths, not thousands of trees, and
none meets another.

The rows are numbered by sorting them into ranges of the whole order (group, id,
digest, row number), counting each range and adding what lies before; so neither
a group, nor an id, nor copies of one row meet in one task.

Cases: a null column counts as `-`; a null id comes first in its group and is
never tampered with; rows with the same id stand in the order of their digests;
equal rows have equal leaves and a proof each; one more than the largest count is
left as it is; a null group comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import RANGE_ROWS, numbered, written

#: Levels of the tree that one block holds; a block is 2^LEVELS leaves.
LEVELS = 12
REPORT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Tree:
    """A persistent tree over the leaves of one block.

    Nodes are (digest, left, right); a node never changes, so versions share them.
    ``height`` levels are built, also above a node that is alone.
    """

    def __init__(self, leaves: list[str], height: int) -> None:
        self.height = height
        nodes: list[tuple] = [(leaf, None, None) for leaf in leaves]
        for _ in range(height):
            nodes = [self._node(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None)
                     for i in range(0, len(nodes), 2)]
        [self.root] = nodes

    @staticmethod
    def _node(left: tuple, right: tuple | None) -> tuple:
        return digest([left[0]] + ([right[0]] if right else [])), left, right

    def changed(self, place: int, leaf: str) -> tuple:
        """The root of a version with another leaf at a place: new are its ancestors only."""

        def copied(node: tuple, level: int) -> tuple:
            if not level:
                return leaf, None, None
            _, left, right = node
            if place >> (level - 1) & 1:
                return self._node(left, copied(right, level - 1))
            return self._node(copied(left, level - 1), right)

        return copied(self.root, self.height)

    def path(self, place: int) -> list[tuple[bool, str | None]]:
        """From the leaf up: whether the node is the right one, and the digest beside it (None: alone)."""
        out, node = [], self.root
        for level in range(self.height - 1, -1, -1):
            _, left, right = node
            on_right = bool(place >> level & 1)
            out.append((on_right, left[0] if on_right else right[0] if right else None))
            node = right if on_right else left
        return out[::-1]


def continued(value: str, path: list[tuple[bool, str | None]]) -> str:
    """The digest at the end of a path for another value at its start: the copied ancestors one by one."""
    for on_right, beside in path:
        value = digest([beside, value] if on_right else [value, beside] if beside else [value])
    return value


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """own_group, doc_id, leaf and the leaf after tampering (null where there is none) of every row."""
    doc_id = F.col("doc_id").cast("long")
    n_chars = F.col("n_chars").cast("long")
    more = F.coalesce(F.try_add(n_chars, F.lit(1).cast("long")), n_chars)

    def leaf(count: Column) -> Column:
        values = [doc_id, F.col("source"), F.col("lang"), count, F.col("text")]
        return F.sha2(F.concat(*[_field(v) for v in values]), 256)

    tampered = F.crc32(doc_id.cast("string")) % 7 == 0
    return docs.select(F.col("lang").cast("string").alias("own_group"), doc_id.alias("doc_id"),
                       leaf(n_chars).alias("leaf"), F.when(tampered, leaf(more)).alias("changed"))


def height_of(size: int) -> int:
    """Levels above `size` leaves until one node is left."""
    return max(0, size - 1).bit_length()


def _storey(nodes: DataFrame, levels: int) -> DataFrame:
    """Every block of nodes (own_group, group_size, place, value) with its root and its nodes' paths.

    group_size counts the nodes of the group in this storey.
    """

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        first = block.iloc[0]
        tree = Tree(block["value"].tolist(), min(levels, height_of(int(first["group_size"]))))
        mask = (1 << levels) - 1
        paths = [tree.path(p & mask) for p in block["place"].tolist()]
        return pd.DataFrame({
            "own_group": block["own_group"], "group_size": block["group_size"], "place": block["place"],
            "sides": [[side for side, _ in path] for path in paths],
            "beside": [[other for _, other in path] for path in paths], "block_root": tree.root[0]})

    return (nodes.groupBy("own_group", F.shiftright("place", levels).alias("block"))
            .applyInPandas(build, "own_group string, group_size long, place long, sides array<boolean>, "
                                  "beside array<string>, block_root string"))


def upper_paths(blocks: DataFrame, largest: int, levels: int = LEVELS) -> DataFrame:
    """own_group, place, sides, beside, subroot: the way of every block root up to its group's root.

    ``blocks`` has own_group, group_size (blocks of the group), place and value;
    ``largest`` is the largest group_size.  A storey's paths are joined to those
    of the storey above by the block that is a node there.
    """
    here = written(_storey(blocks, levels), "storey")
    if largest <= 1 << levels:
        return here.select("own_group", "place", "sides", "beside", F.col("block_root").alias("subroot"))
    nodes = here.select("own_group", F.ceil(F.col("group_size") / (1 << levels)).cast("long").alias("group_size"),
                        F.shiftright("place", levels).alias("place"), F.col("block_root").alias("value")).distinct()
    above = upper_paths(nodes, -(-largest // (1 << levels)), levels).select(
        F.col("own_group").alias("_g"), F.col("place").alias("_p"), F.col("sides").alias("_sides"),
        F.col("beside").alias("_beside"), "subroot")
    same = F.col("own_group").eqNullSafe(F.col("_g")) & (F.shiftright("place", levels) == F.col("_p"))
    return here.join(above, same).select("own_group", "place", F.concat("sides", "_sides").alias("sides"),
                                         F.concat("beside", "_beside").alias("beside"), "subroot")


def block_roots(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """own_group, group_size (in blocks), place (of the block), value of every block of numbered leaves."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        first = block.iloc[0]
        size = int(first["group_size"])
        tree = Tree(block["leaf"].tolist(), min(levels, height_of(size)))
        return pd.DataFrame({"own_group": [first["own_group"]], "group_size": [-(-size >> levels)],
                             "place": [int(first["place"]) >> levels], "value": [tree.root[0]]})

    return (rows.select("own_group", "group_size", "place", "leaf")
            .groupBy("own_group", F.shiftright("place", levels).alias("block"))
            .applyInPandas(build, "own_group string, group_size long, place long, value string"))


def _ways(rows: DataFrame, levels: int) -> DataFrame:
    """own_group, block, sides, beside, subroot, root: the way of every block of leaves up to the root of all."""
    roots = written(block_roots(rows, levels), "blocks")
    largest = roots.agg(F.max("group_size")).first()[0]
    in_group = written(upper_paths(roots, largest or 0, levels), "paths")
    groups = in_group.where("place = 0").select(F.lit(None).cast("string").alias("own_group"),
                                                F.col("own_group").alias("name"), F.col("subroot").alias("value"))
    tops = numbered(groups, ["own_group"], ["name"])
    n_groups = tops.count()
    top_paths = upper_paths(tops.select("own_group", "group_size", "place", "value"), n_groups, levels).select(
        F.col("place").alias("_p"), F.col("sides").alias("_sides"), F.col("beside").alias("_beside"),
        F.col("subroot").alias("root"))
    named = tops.select("name", "place").join(top_paths, F.col("place") == F.col("_p")).drop("place", "_p")
    return (in_group.join(named, F.col("own_group").eqNullSafe(F.col("name")))
            .select("own_group", F.col("place").alias("block"), F.concat("sides", "_sides").alias("sides"),
                    F.concat("beside", "_beside").alias("beside"), "subroot", "root"))


def manifest(docs: DataFrame, levels: int = LEVELS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    folded_root is the root of the row's own version: that of its tampered leaf,
    or of its leaf as it is, folded through the proof.
    """
    # written: it is read once for the roots and once for the proofs, with the same places
    rows = written(numbered(leaves(docs), ["own_group"], ["doc_id", "leaf"], range_rows), "places")
    ways = _ways(rows, levels)

    def prove(key: tuple, block: pa.Table, way: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        [upward] = way.to_pylist()
        above = list(zip(upward["sides"], upward["beside"], strict=True))
        leaf, changed = block["leaf"].to_pylist(), block["changed"].to_pylist()
        tree = Tree(leaf, min(levels, height_of(block["group_size"][0].as_py())))
        proofs, folded = [], []
        higher = [beside for _, beside in above if beside]
        for place, (was, now) in enumerate(zip(leaf, changed, strict=True)):
            own = tree.path(place)
            proofs.append(digest([beside for _, beside in own if beside] + higher))
            version = continued(was, own) if now is None else tree.changed(place, now)[0]
            folded.append(continued(version, above))
        n, root = len(leaf), upward["root"]
        return pa.table({
            "doc_id": block["doc_id"], "leaf": block["leaf"], "subroot": pa.array([upward["subroot"]] * n, pa.string()),
            "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([value == root for value in folded], pa.bool_())})

    return (rows.withColumn("block", F.shiftright("place", levels)).groupBy("own_group", "block")
            .cogroup(ways.groupBy("own_group", "block")).applyInArrow(prove, REPORT))


def copied_nodes(docs: DataFrame, levels: int = LEVELS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """own_group, place, level, node: what each tampered row's version has of its own, from its leaf to the root of all."""
    rows = written(numbered(leaves(docs), ["own_group"], ["doc_id", "leaf"], range_rows), "places")
    ways = _ways(rows, levels)

    def versions(key: tuple, block: pa.Table, way: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        [upward] = way.to_pylist()
        above = list(zip(upward["sides"], upward["beside"], strict=True))
        tree = Tree(block["leaf"].to_pylist(), min(levels, height_of(block["group_size"][0].as_py())))
        out: list[tuple[int, int, str]] = []
        for place, now in enumerate(block["changed"].to_pylist()):
            if now is None:
                continue
            chain, node = [], tree.changed(place, now)
            for level in range(tree.height, -1, -1):
                chain.append(node[0])
                node = node[2] if level and place >> (level - 1) & 1 else node[1]
            chain.reverse()
            for step in above:
                chain.append(continued(chain[-1], [step]))
            out += [(block["place"][place].as_py(), level, value) for level, value in enumerate(chain)]
        group = pa.array([block["own_group"][0].as_py()] * len(out), pa.string())
        place, level, value = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"own_group": group, "place": pa.array(place, pa.int64()),
                         "level": pa.array(level, pa.int32()), "node": pa.array(value, pa.string())})

    return (rows.withColumn("block", F.shiftright("place", levels)).groupBy("own_group", "block")
            .cogroup(ways.groupBy("own_group", "block"))
            .applyInArrow(versions, "own_group string, place long, level int, node string"))

