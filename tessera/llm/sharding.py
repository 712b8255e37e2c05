"""Sharding by a hierarchical weighted hash tree.

A key descends from the root to a shard: at each node every child draws ``-ln(u) / weight``, u a uniform hash of
key and child, and the smallest draw wins, so a child wins in proportion to its weight. A draw depends on that
child alone. So when weights change, a key changes its child at a node only towards a child whose weight
rose or away from one whose weight fell, and rows move only within, into or out of the subtrees whose weights
changed. A tree that grows by a branch of its own at the root takes rows only into that branch.

Everything runs as built-in functions in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import repeated

#: Parts of a shard within which slots are numbered; the table of their sizes has shards x this many rows.
SLOT_PARTS = 1024


@dataclass(frozen=True)
class Node:
    """A shard (``shard`` set) or an inner node; an inner node weighs what its shards weigh together."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    def shards(self) -> list[Node]:
        return [s for c in self.children for s in c.shards()] if self.children else [self]


def tree(regions: int = 2, racks: int = 2, shards: int = 2, weights: dict[int, float] | None = None) -> Node:
    """A regular tree of regions, racks and shards, the shards numbered from 0."""
    weight = (weights or {}).get
    number = iter(range(regions * racks * shards))

    def rack(r: int, k: int) -> Node:
        return Node(f"{r}/{k}", tuple(Node(f"shard {n}", shard=n, own_weight=weight(n, 1.0)) for n in (next(number) for _ in range(shards))))

    return Node("root", tuple(Node(f"{r}", tuple(rack(r, k) for k in range(racks))) for r in range(regions)))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    n = max(s.shard for s in root.shards()) + 1
    shard = Node(f"shard {n}", shard=n, own_weight=weight)
    return Node(root.name, (*root.children, Node(f"region of {n}", (Node(f"rack of {n}", (shard,)),))))


def place(key: Column, node: Node) -> Column:
    """The shard of a key, an integer. Equal draws go to the child that comes first; a null key is a key."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = F.least(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(node.children)])
    won = F.when(F.lit(False), F.lit(0))
    for i, c in enumerate(node.children):
        won = won.when(draws["child"] == i, place(key, c))
    return won


def _draw(key: Column, node: Node) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(float(node.weight))


def assign(docs: DataFrame, root: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its slot there, and its shard if the tree had one more.

    Rows of equal id, size and checksum are counted first and get their slots as a range, so a row that
    repeats without end costs one line in any shuffle, and is made again from it in pieces at the end. A null text has size 1 and the
    checksum of the empty text; of a long text only size and checksum go on; a null id is placed like any other; slots go by id, then size,
    then checksum, ties among the rows alike in these; an empty table gives an empty one; other columns stay behind.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = same.withColumn("shard", place(F.col("doc_id"), root)).withColumn("part", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "size", "text_crc32"), F.lit(SLOT_PARTS)).cast("int"))
    before = F.sum("copies").over(W.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1))
    parts = placed.groupBy("shard", "part").agg(F.sum("copies").alias("rows"))
    first = F.sum("rows").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("shard", "part", F.coalesce(first, F.lit(0)).alias("first"))
    # shards x SLOT_PARTS rows at most, whatever the input
    numbered = placed.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(parts), ["shard", "part"])
    start = F.col("first") + F.col("before")
    return repeated(numbered, "copies", "number").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (start + F.col("number")).alias("slot"),
        place(F.col("doc_id"), grown(root)).alias("grown_shard"),
    )
