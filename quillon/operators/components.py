"""Connected components of links between rows, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import durable


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Neighbours of each vertex are linked to the least of its neighbourhood: the larger ones, or itself and the smaller ones."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if larger_only else both.where("b < a")
    least = side.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    if larger_only:
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = side.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of edges (a, b) but the roots: root is the least vertex it reaches. Vertices may be of any ordered type.

    The rounds grow with the logarithm of a component's width; each one's edges
    go to a reliable checkpoint, and only a digest of them comes to the driver.
    A vertex with very many neighbours is summed map-side before it is joined.
    """
    now = durable(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct())
    seen = None
    while True:
        digest = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if digest == seen or not digest[0]:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen = digest
        now = durable(_to_least(_to_least(now, True), False))
