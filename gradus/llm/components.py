"""Connected components of an undirected graph by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on node ids; the minimum of a node's neighbours is summed on the map side, and the
joins are plain equi-joins of which adaptive execution splits a node with very many neighbours. The edges of a round are written to
the shared folder, so lineage stays short and lost executors redo one round at most. Nothing is collected but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Edges (16 bytes each) up to which the minima of a round are broadcast.
BROADCAST_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any order and repeated at will: (node, component) for each node on an edge, component the smallest
    node that it reaches. A node linked to itself alone is not in the result; null ends are dropped."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = saved(edges, "cc"), None
    while (now := _state(edges)) != before:
        before = now
        if not now[0]:
            break
        # there are no more minima than edge ends, so their number is known
        near = F.broadcast if now[0] <= BROADCAST_EDGES else lambda df: df
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every neighbour above a node goes to the least of its neighbourhood
        least = near(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, F.col("u") == F.col("a")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: a node and its neighbours below go to the least of them
        least = near(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"))
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = saved(small, "cc")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
