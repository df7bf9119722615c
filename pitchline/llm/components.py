"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import release, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the undirected ``edges``; root is the least
    node of its component.  Large-star and small-star steps (Kiveris et al.,
    2014) until the edges no longer change, every step on partial minima and
    joins, its result written: no node's neighbours are ever collected.  The
    tables of a step are removed once the next one is written."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, seen = stored(e, "cc-edges"), None
    while True:
        # large star: the greater neighbours of a node link to its least neighbour
        now_edges = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-least")
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        before, e = [now_edges, least], stored(e, "cc-large")
        release(*before)
        # small star: the lesser neighbours and the node link to the least of them
        least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        hop = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = [e, least], stored(hop.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        release(*before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
