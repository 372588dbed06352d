"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hands itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex with an edge (a, b), a <> b; root: the smallest vertex it reaches.

    Converges in a number of rounds that grows with the logarithm of the
    component's size; each round's edges go to a reliable checkpoint, and only
    a digest of them (two numbers) comes to the driver.
    """
    now = durable(edges.select("a", "b").where("a <> b").distinct())
    seen = None
    while True:
        now = durable(_small_star(_large_star(now)))
        digest = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if digest == seen or not digest[0]:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        seen = digest
