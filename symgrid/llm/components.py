"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgrid.llm.common import durable, hot_join


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, and but for a chance of 2^-128 for no others."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(7), "u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long), undirected, repeated or not. Returns node, root (smallest node
    reachable) for every node that has a link to another; an empty table gives none.

    Each round is two aggregations with map-side minima and two joins over at most as many edges as
    there were links; the edges of a star's centre are spread over tasks (hot_join). Edges are cut from
    their lineage by a checkpoint, and rounds grow with the logarithm of the longest chain.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("rows"))
        large = hot_join(both.filter("v > u"), low, "u", "rows", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
        small = hot_join(large, low, "u", "rows", 2 * state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = durable(small)
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
