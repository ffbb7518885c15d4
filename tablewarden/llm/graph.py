"""Connected components of a link table, by alternating large-star and small-star
joins. Nothing is collected but two numbers a round; each round is cut by a table
in the shared folder. Hubs are safe: minima are pre-aggregated before the shuffle
and written, so the join back has one row per node on a plain side, which AQE can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node ``a`` to the smaller ``b``."""
    least = scratch(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    linked = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b of one integer type);
    root is the smallest node reachable. Null ends and self-links are left out."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = scratch(edges, "links")
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        edges = scratch(_small_star(scratch(_large_star(edges), "large-star")), "star")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
