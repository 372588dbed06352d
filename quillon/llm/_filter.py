"""A Bloom filter of 64-bit values, 16 MB at any number of them: it only saves work, what it lets through is checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._arrow import splitmix

FILTER_BITS = 27
_MASK = np.uint64((1 << FILTER_BITS) - 1)


def member_filter(values: DataFrame) -> np.ndarray:
    """The filter's words, from a frame of one long column without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = splitmix(np.asarray(batch.column(0)).view(np.uint64))
            bits = np.concatenate([h & _MASK, (h >> np.uint64(32)) & _MASK])
            yield pa.RecordBatch.from_arrays([pa.array((bits >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = values.mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[np.asarray(words.column("word").combine_chunks())] = np.asarray(words.column("bits").combine_chunks()).view(np.uint64)
    return out


def in_filter(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which values may be among the filter's; False is certain."""
    h = splitmix(values.view(np.uint64))
    hit = np.ones(len(values), bool)
    for bits in (h & _MASK, (h >> np.uint64(32)) & _MASK):
        hit &= (words[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
    return hit
