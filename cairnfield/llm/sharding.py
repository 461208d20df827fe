"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child of the node draws ``-ln(u) / weight``, u a hash of the row's key and the child's name; the
least draw wins and the row descends. A child's draw depends on its own name and weight alone, so a changed weight
moves rows only into or out of the subtrees on the changed path. ``grow`` hangs a new shard up as a subtree of its own
under the root, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, stage_table

#: Rows a bucket of the slot numbering should hold.
BUCKET_ROWS = 50_000


@dataclass
class Node:
    """An inner node has children; a leaf is a shard with a number and a weight."""

    name: str
    children: list[Node] = field(default_factory=list)
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Node:
    """A full tree of ``regions * racks * shards`` equal shards, numbered in order."""
    number = iter(range(regions * racks * shards))
    return Node("", [Node(f"g{g}", [Node(f"g{g}/r{r}", [Node(f"g{g}/r{r}/s{(s := next(number))}", shard=s) for _ in range(shards)]) for r in range(racks)]) for g in range(regions)])


def grow(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, alone in a new region; all other nodes keep their names and weights."""
    s = sum(1 for _ in leaves(root))
    new = Node(f"g+{s}", [Node(f"g+{s}/r0", [Node(f"g+{s}/r0/s{s}", shard=s, own=weight)])])
    return Node(root.name, [*root.children, new])


def leaves(node: Node):
    if node.children:
        for c in node.children:
            yield from leaves(c)
    else:
        yield node


def inner_nodes(node: Node):
    if node.children:
        yield node
        for c in node.children:
            yield from inner_nodes(c)


def depth(node: Node) -> int:
    return 1 + max(map(depth, node.children)) if node.children else 0


def shard_of(key: Column, root: Node) -> Column:
    """The number of the shard that ``key`` descends to. Children of weight 0 or less take no rows.

    u: 53 bits of the xxhash64 of ``key|child's name``; a null key counts as the text ``null``."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    child = lambda c: F.struct(F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"))
    below = F.create_map(*(x for n in inner_nodes(root) for x in (F.lit(n.name), F.array(*(child(c) for c in n.children if c.weight > 0)))))

    def draw(c: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.concat(text, F.lit("|"), c["name"])), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), c["name"].alias("name"))

    at = F.lit(root.name)
    for _ in range(depth(root)):
        at = F.coalesce(F.array_min(F.transform(F.element_at(below, at), draw))["name"], at)
    numbers = F.create_map(*(x for n in leaves(root) for x in (F.lit(n.name), F.lit(n.shard))))
    return F.element_at(numbers, at)


def assign(docs: DataFrame, root: Node, grown: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    Size: UTF-8 bytes plus 8; a null text has none (size 8, crc 0, as the empty text). A null id is the key ``null``.
    Rows alike in id, size and crc are counted before any shuffle and numbered one after another, so a hot id never
    gathers in a task; other columns of ``docs`` are not read. An empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    alike = stage_table(alike.withColumns({"shard": shard_of(F.col("doc_id"), root).cast("int"), "grown_shard": shard_of(F.col("doc_id"), grown).cast("int")}), "shards")
    n_shards = sum(1 for _ in leaves(root))
    buckets = max(1, alike.count() // (n_shards * BUCKET_ROWS))
    placed = gapless(alike, ["shard"], ["doc_id", "size", "text_crc32"], "_n", "_first", buckets)
    each = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_i")).alias("slot"), "grown_shard")
