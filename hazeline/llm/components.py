"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.session import durable


def _done(edges: DataFrame) -> bool:
    """Every node hangs on exactly one smaller node that hangs on none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionAll(
        edges.select(F.col("v").alias("n"), F.lit(0), F.lit(1)))
    bad = ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return bad.where("low > 1 OR (low > 0 AND top > 0)").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Each round gives the neighbours of a node to the smallest of them, first the larger ones,
    then the smaller ones. A hub is one side of a join with its one-row minimum, so Spark splits
    it; minima combine before the shuffle. Rounds end when all trees are stars (about the
    logarithm of the longest chain); every round is written to the shared folder.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct())
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
