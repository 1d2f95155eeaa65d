"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.llm.frames import checkpointed

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in ``edges`` (columns a, b of one type).

    Alternates two steps until nothing changes: every node hangs its larger neighbours on its
    smallest one, then its smaller neighbours. Both reduce a node's neighbours to a minimum before
    they are joined, so a hub's neighbours are never gathered. Loops and repeated edges are allowed.
    """
    # An edge points from the larger node to the smaller one.
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    nodes = checkpointed(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    edges = checkpointed(edges.filter("a <> b").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = checkpointed(large.distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.filter("a <> b").union(lowest.select("a", F.col("low").alias("b")))
        edges = checkpointed(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
