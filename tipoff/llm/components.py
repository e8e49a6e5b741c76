"""Connected components by alternating large-star and small-star steps, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.frames import BROADCAST_BYTES
from tipoff.session import written


def _small(least: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, one for each node, broadcast if they are few. Else they are written, so that Spark can split a node with very
    many edges where it is joined with them."""
    return F.broadcast(least) if 32 * rows <= BROADCAST_BYTES else written(least, "least")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(_small(least, 2 * n), "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = _small(edges.groupBy("b").agg(F.min("a").alias("m")), n)
    tied = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b")
    return tied.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge: the smallest node that it reaches.

    ``edges`` has two whole-number columns a and b; loops, repeated and reversed edges do no harm. Each round is
    written to the shared folder; rounds grow with the logarithm of a component's diameter.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    mark = _mark(edges)
    while True:
        n = mark[0]
        larger = _large_star(edges, n)  # at most a row for each edge and direction
        edges = written(_small_star(larger, 2 * n), "edges")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
        mark = now


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of all edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
