"""Connected components of an edge table, in joins and aggregates only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewise.llm.common import cut_at, drop_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.filter(F.col("b") > F.col("a")).join(least, "a")
    return linked.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b")
    smaller = linked.filter(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.unionByName(linked.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges (a, b)``; the component is its least node.

    Alternates the two steps until every node hangs on the least of its component, which takes about as many
    rounds as the logarithm of the longest path. Each round is written down.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )
    edges, path = cut_at(edges.distinct())
    while True:
        # Stars: no node is both a centre and a leaf, and no leaf has two centres.
        centres, leaves = edges.select("a").distinct(), edges.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        bad = leaves.filter(F.col("n") > 1).select("b").unionByName(
            leaves.join(centres, leaves.b == centres.a, "left_semi").select("b")
        )
        if bad.isEmpty():
            break
        before = path
        edges, path = cut_at(_small_star(_large_star(edges)))
        drop_table(edges.sparkSession, before)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
