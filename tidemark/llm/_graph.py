"""Connected components of an edge table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm._spark import saved


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent), by pointer jumping."""
    trees = saved(parent.select("node", F.col("parent").alias("root")))
    while True:
        up, further = (trees.select(F.col("node").alias(a), F.col("root").alias(b)) for a, b in (("root", "above"), ("above", "top")))
        moved = Observation()
        higher = trees.join(up, "root").join(further, "above").select("node", F.col("top").alias("new"), "root")
        higher = higher.observe(moved, F.count_if(F.col("new") != F.col("root")).alias("n"))
        trees = saved(higher.select("node", F.col("new").alias("root")))
        if not moved.get["n"]:
            return trees


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, contracts the trees that
    arise to their roots, and goes on with the edges between different roots, which are
    soon few.
    """
    a, b = F.col("a"), F.col("b")
    links = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(a != b).distinct())
    names = None
    while True:
        both = links.unionAll(links.select(b.alias("a"), a.alias("b")))
        parent = both.groupBy(a.alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("parent"))
        trees = _roots(parent)
        if names is None:
            names = trees.select("node", F.col("root").alias("component"))
        else:
            step = trees.select(F.col("node").alias("component"), "root")
            names = saved(names.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        left = links.join(trees.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(trees.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        links = saved(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if not links.limit(1).count():
            return names
