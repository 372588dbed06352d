"""The corpus pipeline over ``documents``: five stages, each an operator of quillon.llm.

Every stage works on all rows its predecessor kept; what it decides takes
effect in what it returns. All but the last return the columns of ``documents``,
whatever others came in. An empty table gives an empty one. A row with a null
in any column is a row like others; what a null text or id means to a stage,
and what it does with repeated rows and very long texts, is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, line_dedup, mixing, packing, toxicity
from quillon.llm.registry import SEED, learnable
from quillon.session import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under one half stay.

    The score depends on the whole text alone, so copies and repeated rows go or
    stay together; a null or empty text has no feature and is scored as such.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable(F.col("doc_id")))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the blocks of lines they share with a document of smaller id; those left without words go.

    Rows with a null text or id are left alone, rows that share an id are not
    compared with each other, and repeated rows get the same result.
    """
    rows = line_dedup.dedup(docs.select(*COLUMNS))
    left = F.col("removed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.where(left).withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at 0.8 stays; so do rows without id or words.

    Rows that share an id are one document, so they stay or go together.
    """
    groups = jaccard.near_duplicates(docs, n=5, percent=80)
    later = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(later, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 2 times.

    A null text has size 0, a null source is a source of its own, repeated rows
    are drawn each on its own; ties in size stand in order of id and content.
    """
    return mixing.mix(docs.select(*COLUMNS), seed=SEED)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null text is its end id alone; repeated rows are packed as often as they occur.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]

#: No SQL can express the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
