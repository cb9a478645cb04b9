"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.llm.common import stored


EDGES_PER_TASK = 200_000


def _is_star(edges: DataFrame, tasks: int) -> bool:
    """Whether every left node has one edge, to a node that is never on the left."""
    right = edges.select(F.col("b").alias("a"), F.lit(2).alias("n")).distinct()
    sides = edges.select("a", F.lit(1).alias("n")).union(right)
    # A left node counts 1 per edge; a node on both sides counts 2 more.
    both = sides.groupBy("a").agg(F.sum("n").alias("n"), F.min("n").alias("least")).coalesce(tasks)
    return both.where("least = 1 AND n > 1").limit(1).count() == 0


def _least(edges: DataFrame) -> DataFrame:
    """(a, least): the smallest of a node and its neighbours, for every node on the left."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Rounds grow with the logarithm of the number of nodes.  Every step is an aggregation
    or an equi-join on edges, so no component is ever gathered.  Direction, repetition and
    loops of edges don't matter; without edges the result is empty.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    # Contraction never adds edges, so that a task for so many suffices throughout.
    tasks = max(8, edges.count() // EDGES_PER_TASK)
    while not _is_star(edges, tasks):
        # Large star: a node's larger neighbours move to its smallest neighbour.
        both = edges.union(edges.select("b", "a"))
        large = both.where("b > a").join(_least(both), "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").coalesce(tasks).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = _least(large)
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(least.select("a", F.col("least").alias("b")))
        )
        edges = stored(small.where("a <> b").coalesce(tasks).distinct().coalesce(tasks), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
