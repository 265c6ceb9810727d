"""Connected components of an edge table by randomised contraction, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small_or_shuffled


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b of one type); nodes are linked if they share a root.

    Each round, every node hangs itself under the neighbour that comes first in a hash order drawn anew, or under itself;
    edges are then rewritten to those parents and self-loops dropped. A constant share of nodes disappears each
    round whatever the shape of the graph. Neighbours are reduced by min, which combines before the shuffle, so
    a hub costs no more than its edges. Null ends and self-loops are ignored; an empty table gives an empty one.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = e.schema["a"].dataType
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        turn = F.lit(len(rounds))
        first = lambda c: F.struct(F.xxhash64(F.col(c), turn).alias("h"), F.col(c).alias("id"))
        both = e.select(F.col("a").alias("v"), first("b").alias("u")).union(e.select(F.col("b").alias("v"), first("a").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("u"))  # combines before the shuffle
        parent = cut(low.select("v", F.least(F.col("u"), first("v")).getField("id").alias("p")))
        rounds.append(parent)
        at_a, at_b = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = e.join(at_a, "a").join(at_b, "b").where("pa <> pb")
        e = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return e.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
    out = rounds[0].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for later in rounds[1:]:
        step = later.select(F.col("v").alias("root"), F.col("p").alias("up"))
        out = out.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out


def merged(root: DataFrame, links: DataFrame) -> DataFrame:
    """``root`` (node, root; cut) after further ``links`` (a, b) between nodes or roots, which are few, so that groups are joined on a small graph."""
    at = lambda c: small_or_shuffled(root, BROADCAST_ROWS).select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    new = cut(components(ends))
    step = small_or_shuffled(new.select(F.col("node").alias("root"), F.col("root").alias("up")), BROADCAST_ROWS)
    moved = root.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return cut(moved.union(new.join(root.select("node"), "node", "left_anti")))  # a root is a node of its own group
