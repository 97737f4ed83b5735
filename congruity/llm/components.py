"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def is_star(edges: DataFrame) -> bool:
    """Whether every vertex points at one root, and no root points anywhere."""
    inner = edges.select(F.col("b").alias("a")).distinct().join(edges, "a", "left_semi")
    return inner.isEmpty() and edges.groupBy("a").count().filter("count > 1").isEmpty()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every vertex but the smallest of its component, which is b.

    ``edges`` has columns a and b of one orderable type; loops and nulls are
    dropped. Each round is written to the shared folder, and the number of rounds
    grows with the logarithm of the longest chain.
    """
    found = staged(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not is_star(found):
        found = staged(small_star(large_star(found)))
    return found
