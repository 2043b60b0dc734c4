"""Connected components of a graph of any size, by contraction: every node points to its least neighbour, pointers are followed to
their roots, and the edges between roots are the next, smaller graph. Each round is a few joins on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); a component goes by its least node."""
    edges = materialize(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    labels = materialize(both.distinct().select("node", F.col("node").alias("component")), "labels")
    while not edges.isEmpty():
        # pointers go to lesser nodes only, so they make no circles; a node without a lesser neighbour is a root
        up = materialize(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("y")), "up")
        while True:
            onward = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
            jumped = materialize(up.join(onward, "y", "left").select("x", F.coalesce("z", "y").alias("y"), F.col("z").isNotNull().alias("moved")), "jump")
            up = jumped.select("x", "y")
            if jumped.where("moved").isEmpty():
                break
        to = lambda df, c: df.join(up.select(F.col("x").alias(c), "y"), c, "left").withColumn(c, F.coalesce("y", c)).drop("y")
        labels = materialize(to(labels, "component"), "labels")
        edges = to(to(edges, "a"), "b").where("a <> b")
        edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels
