"""Documents to shards by a hierarchical weighted hash tree.

The tree has regions, racks in regions and shards in racks; a node weighs what
its shards weigh.  A document descends from the top: at every node each child
draws a hash of (document id, child's name), u in (0, 1), and the child with the
largest ln(u) / weight wins, which it does with a chance in proportion to its
weight.  A draw depends on nothing but the document and the child, so a change of
weight moves documents only into or out of the subtrees whose weights change.

grown(tree) adds one shard as a region of its own: it is the only node whose draw
is new, so documents move into that shard and nowhere else.  (A shard added to a
rack would also raise the weight of its rack and region, and what they win would
spread over their old shards too.)

Law: `key`.  The document id and the tree decide; equal texts are not kept
together.  Cases: null text has size 1 and checksum 0; null ids draw like a value
of their own; repeated rows share a shard and take separate slots; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Rows of a shard that one task numbers.
ROWS_PER_PIECE = 4096


@dataclass(frozen=True)
class Node:
    """A shard (with a number and a weight) or the parent of others."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> Iterator[Node]:
        if not self.children:
            yield self
        for child in self.children:
            yield from child.shards()


def balanced(regions: int, racks: int, shards: int) -> Node:
    """A tree of equal weights, shards numbered from 0."""
    number = iter(range(regions * racks * shards))
    return Node("all", tuple(
        Node(f"region-{r}", tuple(
            Node(f"region-{r}/rack-{k}", tuple(
                Node(f"shard-{n}", shard=n) for n in (next(number) for _ in range(shards))))
            for k in range(racks)))
        for r in range(regions)))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    n = 1 + max(node.shard for node in tree.shards())
    name = f"region-of-{n}"
    shard = Node(f"shard-{n}", shard=n, own_weight=weight)
    return replace(tree, children=(*tree.children, Node(name, (Node(f"{name}/rack-0", (shard,)),))))


def draw(key: Column, node: Node) -> Column:
    """ln(u) / weight, u from the upper 53 bits of a hash of key and the node's name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11)
    return F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(node.weight)


def shard_of(key: Column, tree: Node) -> Column:
    """The shard a key descends to."""
    if not tree.children:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return shard_of(key, tree.children[0])
    draws = [draw(key, child) for child in tree.children]
    best = F.greatest(*draws)
    chosen = shard_of(key, tree.children[-1])
    for child, own in reversed(list(zip(tree.children[:-1], draws[:-1], strict=True))):
        chosen = F.when(own == best, shard_of(key, child)).otherwise(chosen)
    return chosen


def place(docs: DataFrame, tree: Node, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Slots are numbered piece by piece: a shard's rows are dealt to pieces by a hash
    of their row number, so rows that share an id are dealt like all others; each
    piece is counted and starts where those before it end.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # written without texts, so that a row has one number whenever it is read
    rows = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), shard_of(F.col("doc_id").cast("long"), tree).cast("int").alias("shard"),
        shard_of(F.col("doc_id").cast("long"), grown(tree)).cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("row")), "sizes")
    pieces = max(1, -(-rows.count() // (rows_per_piece * sum(1 for _ in tree.shards()))))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(pieces)).cast("int"))
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    before = counts.select("shard", "piece", (F.sum("rows").over(Window.partitionBy("shard").orderBy("piece"))
                                              - F.col("rows")).alias("before"))
    own = Window.partitionBy("shard", "piece").orderBy("row")
    return (rows.withColumn("within", F.row_number().over(own) - 1).join(before, ["shard", "piece"])
            .select("doc_id", "size", "text_crc32", "law", "shard",
                    (F.col("before") + F.col("within")).alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, tree: Node, path: str) -> None:
    """The documents themselves, one folder a shard."""
    (docs.withColumn("shard", shard_of(F.col("doc_id").cast("long"), tree))
     .write.partitionBy("shard").parquet(path))
