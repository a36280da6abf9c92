"""Connected components of a graph that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    `edges` has the columns `a` and `b`, 64-bit integers. Large star and small star take
    turns: each node's neighbours are tied to its smallest neighbour. Stars keep the number
    of edges, and the rounds grow with the logarithm of the longest path. Every round is
    written, so lineage stays short. A node with very many neighbours is never gathered:
    the smallest neighbour is an aggregate, and the tie is a join. Stars compress well, so
    their files say little of their rows: no join may broadcast them.
    """
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("m")
        )
        large = both.filter("b > a").join(least.hint("merge"), F.col("a") == F.col("node")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        )
        large = written(large.distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        small = down.join(least.hint("merge"), F.col("a") == F.col("node")).select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = written(small.select("e.*").filter("a <> b").distinct(), "small")
        # Stars do not change any more when no centre has a smaller neighbour.
        leaves = small.select("a")
        centres = small.select(F.col("b").alias("c")).distinct()
        linked = centres.join(leaves.distinct().hint("merge"), F.col("c") == F.col("a"), "left_semi")
        many = small.groupBy("a").count().filter("count > 1")
        edges = small
        if linked.isEmpty() and many.isEmpty():
            break
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
