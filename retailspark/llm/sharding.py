"""Shard placement by a hierarchical weighted hash tree.

A topology is regions of racks of shards.  A key descends one level at a time:
every child of the current node draws ``-ln(u) / weight`` with ``u`` in (0, 1)
from a hash of (key, child's name), and the smallest draw wins.  A child's
draw depends on nothing but the key, its name and its weight, so

* a child is chosen with probability weight / sum of weights;
* when one child's weight grows, keys move only into that child; when it
  shrinks, keys move only out of it.  Below a node whose weights did not
  change, nothing moves.

A shard added as a region of its own therefore takes rows only into itself; a
shard added to a rack makes rows move only into that rack's region.

All draws are native expressions: one projection, no shuffle, no state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_within


@dataclass(frozen=True)
class Node:
    """``name`` is unique in the tree and must stay the same when the tree
    grows.  Leaves carry ``shard`` and ``weight``; inner nodes ``children``."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    weight: float = 1.0

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else float(self.weight)


def tree(spec: dict[str, dict[str, dict[int, float]]]) -> Node:
    """Region name -> rack name -> shard number -> weight."""
    return Node("root", tuple(
        Node(f"region:{region}", tuple(
            Node(f"rack:{region}/{rack}", tuple(Node(f"shard:{s}", (), s, w) for s, w in shards.items()))
            for rack, shards in racks.items()))
        for region, racks in spec.items()))


def _draw(key: Column, node: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(node.total)


def place(key: Column, node: Node) -> Column:
    """The shard of ``key`` below ``node``.  A null key is a key like others.
    Children of weight 0 are never chosen."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.total > 0]
    if not live:
        raise ValueError(f"{node.name} has no child with a weight")
    if len(live) == 1:
        return place(key, live[0])
    won = F.least(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])["i"]
    out = F.when(won == 0, place(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(won == i, place(key, c))
    return out


#: Shards 0 to 7 of equal weight; and the same with shard 8 as a region of its own.
EIGHT = {"a": {"a0": {0: 1.0, 1: 1.0}, "a1": {2: 1.0, 3: 1.0}}, "b": {"b0": {4: 1.0, 5: 1.0}, "b1": {6: 1.0, 7: 1.0}}}
NINE = EIGHT | {"c": {"c0": {8: 1.0}}}


def shard_documents(docs: DataFrame, before: Node, after: Node) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    Law ``key``: doc_id and the tree decide, so repeated rows of a doc_id share
    a shard and get a slot each; a null doc_id is a key like others.  A null
    text has size 1 and the CRC of no bytes, 0.  Only narrow columns are
    shuffled (for the slots); an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id").count()
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), before).alias("shard"),
        place(F.col("doc_id"), after).alias("grown_shard"),
    )
    out = number_within(narrow, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", rows)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
