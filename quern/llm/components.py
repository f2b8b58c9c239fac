"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Edges are pairs (a, b) of longs. A large-star step joins each edge's larger node to the least neighbour of its
smaller node; a small-star step joins a node's smaller neighbours to the least of them. Both keep components and
never add edges; when nothing changes, every edge leads to the smallest node of its component. Each step is two
shuffles on node ids; the minima are written first, so that Spark can split the join of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another; root: the smallest node it can reach."""
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = cut(ordered.distinct()), None
    while (state := signature(now)) != before:
        before = state
        least = now.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).groupBy("x.u").agg(F.min("x.v").alias("m"))
        large = cut(now.join(cut(least), F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).where("a <> b").distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"))
        joined = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        now = cut(joined.select("x.a", "x.b").where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def signature(edges: DataFrame) -> tuple:
    """Changes whenever the set of edges does, but for chance."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a))")).first())
