"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import written


def _jumped(parents: DataFrame) -> DataFrame:
    """Every node led straight to the root of its tree, by doubling the steps."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        longer = written(
            parents.join(above, "parent").select("node", "parent", "further"), "components-jump"
        )
        if longer.where("parent <> further").isEmpty():
            return parents
        parents = longer.select("node", F.col("further").alias("parent"))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected with, for each end of an edge.

    ``edges`` has a and b. Each round joins every node to its smallest neighbour, draws
    the trees that arise to single nodes, and keeps the edges between them; at least half
    of the nodes that still have an edge go. Edges with a null end, loops and repeated
    edges are ignored, except that a loop makes its node appear. All tables are narrow, and
    each is written before it is used twice.
    """
    edges = written(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "components-edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node")))
    labels = written(ends.distinct().withColumn("root", F.col("node")), "components-labels")
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b"))
        parents = _jumped(
            written(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "components-parents")
        )
        moved = labels.join(parents.withColumnRenamed("node", "root"), "root", "left")
        labels = written(moved.select("node", F.coalesce("parent", "root").alias("root")), "components-labels")
        ends_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("to_a"))
        ends_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("to_b"))
        drawn = edges.join(ends_a, "a").join(ends_b, "b").where("to_a <> to_b")
        edges = written(
            drawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            "components-edges",
        )
    return labels
