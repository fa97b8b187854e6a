"""Connected components over a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import cut, drop


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """``node, label`` for every node in ``links`` (``a``, ``b``); the label is the least node of the component.

    Rounds of large-star and small-star (Kiveris et al., 2014): every node hands its neighbours to the least of them
    until only stars are left. Each round is a minimum per node, combined before the shuffle, and a join, and their
    results are written to the shared folder. The join reads both sides anew, so that adaptive execution can split a node that
    very many links lead to. Links of a node to itself only name the node.
    """
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(limit):
        # large star: of all neighbours, the greater ones go to the least
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        heads = cut(both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "heads")
        large = both.where("v > u").join(heads, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its lesser neighbours go to the least of them
        large = cut(large, "edges")
        drop(heads)
        heads = cut(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "heads")
        small = large.join(heads, F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        small = cut(small, "edges")
        drop(large, heads, edges)
        edges = small
        # links that do not change any more are stars
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u"), F.col("v"))
    out = cut(nodes.join(stars, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("label")), "labels")
    drop(edges)
    return out
