"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from
(node, row key), and the smallest draw wins: children get rows in proportion to their weight, and when the weight
of one child changes, rows move only into or out of that child. A change therefore stays within the subtrees whose
weight it changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import durable


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. ``name`` is stable and unique; a leaf holds ``shard`` and its own ``weight``."""

    name: str
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def balanced_tree(regions: int = 2, racks: int = 2, shards: int = 2) -> Node:
    """A root over ``regions`` x ``racks`` x ``shards`` leaves of weight 1, numbered from 0."""
    number = iter(range(regions * racks * shards))
    return Node("root", tuple(
        Node(f"region{r}", tuple(
            Node(f"region{r}/rack{k}", tuple(Node(f"shard{i}", (), i) for i in (next(number) for _ in range(shards))))
            for k in range(racks)))
        for r in range(regions)))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def with_shard(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a rack and region of its own, so that rows move only into it.

    A shard added to an existing rack also raises the weight of its region, and rows that enter the region
    would spread over all its racks; a region of its own has no other shard to enter.
    """
    shard = max(x.shard for x in leaves(root)) + 1
    leaf = Node(f"shard{shard}", (), shard, weight)
    return Node(root.name, (*root.children, Node(f"region-of-{shard}", (Node(f"region-of-{shard}/rack", (leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    """Exponential draw of rate ``weight`` from 53 hashed bits of (node, row)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{node.name}:"), key)), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(2.0 ** 53)) / F.lit(float(node.weight))


def place(node: Node, key: Column) -> Column:
    """The shard of a row: the descent written as one expression. ``key`` is a string column, never null."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(node.children[0], key)
    # the child with the least draw, ties to the earlier child
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]))["i"]
    out = F.when(best == 0, place(node.children[0], key))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(best == i, place(c, key))
    return out


def shard_documents(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    The law is ``key``: the id and the tree alone decide. ``slot`` numbers a shard's rows from 0 without gaps in
    the order of id, size, CRC. Null ids share the key of an empty string and come first; a null or empty text has
    size 1 and CRC 0; repeated rows are kept and numbered one after another; other columns are ignored; an empty
    table gives no rows. Only 30-byte digests are shuffled: they are range-partitioned by (shard, id, ..., row
    number), which splits a hot shard and also a hot id, and numbered from partition counts.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), place(tree, key).alias("shard"),
        (place(grown, key) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_row"))
    digest = durable(digest, "shard-digests")
    order = ["shard", "doc_id", "size", "text_crc32", "_row"]
    placed = durable(digest.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("_at", F.monotonically_increasing_id()), "shard-order")
    # a partition holds runs of shards; _at is consecutive within it, so a run's first _at is its zero
    part = F.shiftrightunsigned(F.col("_at"), 33)
    runs = (placed.groupBy(part.alias("_part"), "shard").agg(F.min("_at").alias("_zero"), F.count("*").alias("_n")))
    before = runs.alias("a").join(runs.select("shard", F.col("_part").alias("_p"), F.col("_n").alias("_m")).alias("b"), "shard") \
        .groupBy("_part", "shard", "_zero").agg(F.sum(F.when(F.col("_p") < F.col("_part"), F.col("_m")).otherwise(0)).alias("_before"))
    return (placed.withColumn("_part", part).join(before, ["_part", "shard"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_before") + F.col("_at") - F.col("_zero")).alias("slot"), "grown_shard"))
