"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b: long); nodes of one component share one root.

    In each round every node points to the neighbour (or itself) of the lowest hash, pointers are followed once
    more, and edges are drawn anew between the nodes pointed to. Hashes make the order random, so a constant part
    of the nodes goes in each round, also on long chains. The minimum is combined before its shuffle, so a node
    with very many neighbours is no large group. Each round is written to the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    begun = False
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"))
        near = cut(lowest.select(F.col("a").alias("node"), F.least("m", own)["to"].alias("root")), "pointers")
        far = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        points = cut(near.join(far, "root").select("node", F.col("next").alias("root")), "pointers")
        if begun:
            step = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            old, labels = labels, cut(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
            drop(old)
            spent = [near, points]
        else:
            labels, begun, spent = points, True, [near]
        left, right = (points.select(F.col("node").alias(n), F.col("root").alias(f"{n}_to")) for n in "ab")
        drawn = edges.join(left, "a").join(right, "b").where("a_to <> b_to")
        spent.append(edges)
        edges = cut(drawn.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        for table in spent:
            drop(table)
    return labels
