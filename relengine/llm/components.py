"""Connected components of a graph that is given by its edges, with DataFrame operations only.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): each step hangs neighbours of a node on the least node among them, until every
edge leads to its component's least node. No neighbourhood is collected: a node's least neighbour
is an aggregate, and the join back can be split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relengine.llm.common import durable, free


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of an edge.

    edges: a and b, of one orderable type; loops, repeated and reversed edges don't matter, edges
    with a null end are ignored. Nodes without an edge to another one are not in the result.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "components")
    before = None
    while True:  # each round makes a node's root smaller or leaves all as they are
        now = _mark(edges)
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        # Large star: each larger neighbour of a node goes to the least of the node and its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, durable(small, "components")
        free(last)
