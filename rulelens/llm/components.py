"""Connected components by alternating large-star and small-star steps.

Every step is a minimum with map-side combine and a join, so a node with very many neighbours is never one
task's group (the join's large partitions are split by AQE). Edges are stored after each
round; the driver sees one answer per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulelens.session import stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger node ``a`` to the smaller node ``b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    return near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones: then each component is a star around its root."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    between = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return several.unionByName(between).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, where root is the smallest node reachable. ``edges``: a, b."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        edges = stored(_small(_large(edges)), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
