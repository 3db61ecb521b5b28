"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps: every node links its larger (then its smaller)
neighbours to the smallest node it knows, until the edges are stars around the smallest
node of each component.  Each step is one aggregation and one join; a node's smallest
neighbour is combined before the shuffle, and no neighbour list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberscope.llm.tables import settled


def _by_a(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least of their ``a``.  The second key keeps the join from taking over the
    partitions of the aggregate, so that adaptive execution can split an ``a`` of many edges."""
    again = F.xxhash64("a")
    return edges.withColumn("_a", again).join(least.withColumn("_a", again), ["a", "_a"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b; the result has the same form."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = _by_a(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = _by_a(edges, least).select("b", "m", "a")
        linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b")))
    return linked.where("a > b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node with an edge; ``edges`` has columns a and b of one type.

    Loops and repeated edges are allowed; nulls link nothing.  The rounds stop when a round
    changes no edge; they grow with the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = settled(edges, label)
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )
        state = tuple(now)
        edges = settled(_star(_star(edges, True), False), label)
