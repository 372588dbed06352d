"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source_size times in the mix.
Within its source, documents stand in order of size (then of their bucket and
id), so each stretch of the order holds like sizes; the expected copies are
summed along that order, one random offset is added, and a document is emitted
once for each integer boundary its stretch crosses.

Work on Spark: only (id, source, size) is shuffled. A document's place in its
source is the count of the groups (source, size, bucket) before its own, from
a small aggregate, plus its place within the group, so no window runs over the
documents of a whole source, and a hot source or a hot size is split over its
buckets. Windows over sources hold one row for each source, those over a
source's sizes one for each different size.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a source of size 0 has target 0 and takes nothing; repeated rows
count and are sampled each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 64


def words(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(seed: int) -> float:
    """The one random offset in [0, 1) that a seed stands for."""
    return random.Random(seed).random()


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[float, ...]) -> DataFrame:
    """Per source (source, source_size): its target, by filling up in order of cap * size / weight.

    The mix of ``share`` times all sizes is shared by weight; a source stops at
    ``cap`` times its own size and the excess is shared again among the rest.
    There is one row per source here, so the windows hold a few rows.
    """
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") - 1) % len(weights) + 1)
    weighed = ranked.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    level = weighed.select(
        "source",
        "source_size",
        "weight",
        "most",
        F.sum("source_size").over(Window.partitionBy()).alias("all_sizes"),
        F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    ).withColumn("level", (F.lit(float(share)) * F.col("all_sizes") - F.col("capped")) / F.col("open_weight"))
    full = F.col("most") <= F.col("level") * F.col("weight")
    final = F.max(F.when(~full, F.struct(-F.col("capped"), F.col("level")))).over(Window.partitionBy())["level"]
    return level.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * final).alias("target"))


def sample(docs: DataFrame, size: Column, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 0, whole: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document; whole: and its row as a struct."""
    kept = ["whole_row"] if whole else []
    row = [F.struct(*docs.columns).alias("whole_row"), F.xxhash64(*docs.columns).alias("row_hash")] if whole else []
    bucket = F.coalesce(F.pmod("doc_id", F.lit(BUCKETS)), F.lit(-1))
    # one name for each source, the null one too, so that plain keys serve the joins and the window, and whole rows are shuffled once
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = docs.select("doc_id", "source", name.alias("source_name"), size.alias("size"), bucket.alias("bucket"), *row)
    groups = sized.groupBy("source_name", "source", "size", "bucket").agg(F.count("*").alias("n"))
    # sizes first (one row each), then buckets within a size: both windows hold pre-aggregated rows
    by_size = groups.groupBy("source_name", "source", "size").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source_name").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before_size = by_size.select("source_name", "size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_size"))
    key = ["source_name", "size", "bucket"]
    within = Window.partitionBy("source_name", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    in_size = groups.select(*key, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before_bucket"))
    aim = targets(by_size.groupBy("source_name", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), share, cap, weights)
    aim = aim.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_name"), "source_size", "target")
    first = in_size.join(before_size, ["source_name", "size"]).select(*key, (F.col("before_size") + F.col("before_bucket")).alias("before")).join(aim, "source_name")
    # rows that share an id stand in the order of their content, so the mix doesn't depend on how rows are spread
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", *(["row_hash"] if whole else [])))
    ranked = sized.join(first, key).withColumn("nth", nth)
    rank = F.col("before") + F.col("nth")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.lit(offset_of(seed))
    copies = F.floor(expected * rank + offset) - F.floor(expected * (rank - 1) + offset)
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *kept)


def mix(docs: DataFrame, size: Column | None = None, **options: object) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as given."""
    size = words(F.col("text")) if size is None else size
    taken = sample(docs, size, whole=True, **options).where("copies > 0")
    return taken.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")
