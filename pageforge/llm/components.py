"""Connected components of a distributed set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageforge.llm.common import cut, drop


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and none of those has one: each component is a star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1")
    return odd.isEmpty()


def components(links: DataFrame, where: str, name: str = "links") -> DataFrame:
    """(node, component): for each node in a link (columns a, b) the smallest node that links lead to; a table `name`.

    Alternating large-star and small-star rounds: every node's larger neighbours, then its smaller ones, are linked to
    the smallest of them, until all are stars; the number of rounds grows with the logarithm of the longest path.
    Each round is written to the shared folder, so lost executors cost one round at most.  Per node only a minimum is
    computed and joined back: no list of neighbours is gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges, where, f"{name}-0")
    step = 0
    while not _is_done(edges):
        step += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima go to files, so that both sides of the joins are plain exchanges, which Spark can split where one node is hot.
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), where, f"{name}-{step}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = cut(large.distinct(), where, f"{name}-{step}-large")
        down = cut(kept.groupBy("u").agg(F.min("v").alias("m")), where, f"{name}-{step}-down")
        small = kept.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), where, f"{name}-{step}")
        drop(links.sparkSession, where, f"{name}-{step}-least", f"{name}-{step}-large", f"{name}-{step}-down", f"{name}-{step - 1}")
    up = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = cut(up.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), where, name)
    drop(links.sparkSession, where, f"{name}-{step}")
    return out
