"""Vectorised text helpers that work on Arrow string columns inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased A-Z only, read from the UTF-8
bytes without making Python strings. Hashes are 64 bits wide and the same on
every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes handled at a time; a longer word extends its segment.
SEGMENT = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, over an array."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(977))
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept between calls up to one segment."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + 4096), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= SEGMENT + 4096:
            _powers[key] = have
    return have[:n]


class Spans:
    """Hashes of stretches of one array of codes; table: a random value per code."""

    def __init__(self, codes: np.ndarray, table: np.ndarray):
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(table[codes] * _power(_BASE, len(codes)), out=self.total[1:])
        self.inverse = _power(_INVERSE, len(codes) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spans = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return splitmix(spans + (ends - starts).astype(np.uint64) * _ODD)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``codes``."""
    return Spans(codes, table).hashes(starts, ends) if len(starts) else np.zeros(0, np.uint64)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, from zero; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def _segments(data: np.ndarray, space: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Cut points on white space, about SEGMENT bytes apart."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + SEGMENT, n)
        while end < n and not space[data[end - 1]]:
            gap = np.flatnonzero(space[data[end : end + SEGMENT]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + SEGMENT, n)
        yield at, end
        at = end


def word_spans(column: pa.Array, fold: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte of every word in order; index of each text's first word and the end); space: the bytes between words."""
    data, offsets = string_bytes(column)
    table = _FOLDED if fold else _BYTE
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _segments(data, space):
        part = data[a:b]
        solid = ~space[part]
        left = np.empty(len(part), bool)
        left[0] = True
        left[1:] = ~solid[:-1]
        left |= first[a:b]
        right = np.empty(len(part), bool)
        right[-1] = True
        right[:-1] = ~solid[1:]
        right |= first[a + 1 : b + 1]
        s, e = np.flatnonzero(solid & left), np.flatnonzero(solid & right) + 1
        hashes.append(span_hashes(part, s, e, table))
        starts.append(s + a)
        ends.append(e + a)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets).astype(np.int64)


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of each text's first word and the end)."""
    hashes, _, _, first = word_spans(column, fold)
    return hashes, first


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end]; a run depends on the order of its values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.full(len(values) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(values) + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:-1], out=total[1:])
    return splitmix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def sub_batches(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of ``column`` each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = string_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most ``BATCH_ROWS`` rows where the session has Spark's default of 10,000.

    A batch is held whole on both sides of the pipe to Python, and texts may be long.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == "10000":
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of short rows, put together into longer ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
