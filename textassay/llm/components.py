"""Connected components of an edge table, by alternating stars.

Every round is joins and aggregates over edges; nothing is collected, and the
edges are written to the shared folder between rounds.  The hub of a giant
component has an edge to each of its nodes: joins on it are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, written


def _hung(edges: DataFrame, least: DataFrame, label: str) -> tuple[str, DataFrame]:
    """The edges' far ends ``b`` under ``m``, the least node known at their near ends ``a``; and the scratch path."""
    path, stored = written(least, label)
    return path, salted_join(edges, stored, ["a"], "n", ["b"])


def _large_star(edges: DataFrame) -> tuple[str, DataFrame]:
    """Hang the larger neighbours of each node onto the smallest in its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    path, hung = _hung(both, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "large-star")
    return path, hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> tuple[str, DataFrame]:
    """Hang each node and its smaller neighbours onto the smallest of them; a > b in ``edges``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    path, hung = _hung(edges, least, "small-star")
    moved = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return path, moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge (columns a, b); root is the component's smallest node.

    An edge from a node to itself, or one that repeats, changes nothing; a null
    end is no node.  Without edges the result is empty.
    """
    spark = edges.sparkSession
    path, now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(found) == mark or not found[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(found)
        large_path, large = _large_star(now)
        between_path, between = written(large, "edges")
        small_path, small = _small_star(between)
        next_path, now = written(small, "edges")
        for old in (path, large_path, between_path, small_path):
            discard(spark, old)
        path = next_path
