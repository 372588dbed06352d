"""Substring dedup by line and paragraph hashing.

Units are whole lines ("line"), runs of lines between blank ones ("paragraph")
and, as a line may run to hundreds of words and a passage may stand inside one,
runs of sentences ("run"). A text is cut into sentences after a word that ends
in . ! or ?, at a line's end, and, in what is then longer than ``longest``
words, also between some pairs of words that their hashes choose; from each
sentence the shortest run of at least ``min_words`` words forward is a unit,
and so is the shortest one back. So units don't depend on what stands
around them, and each sentence of a repeated stretch of sentences that holds
``min_words`` words lies in a unit that repeats. What stays is the part of a
passage before its first and after its last cut, where it is entered or left
inside a sentence.

Units are normalised (A-Z folded, white space aside) and hashed to 64 bits
twice; equal digests are one group over all documents. The occurrence that
ranks first (by doc_id, then place) stays, the others are removed (of one that
overlaps the first in its own text, the part behind it); units under
``min_words`` words always stay. The places of removed and kept text are
offsets into the original text, in code points, and ``text`` is its kept
stretches, one after the other, unchanged.

Work on Spark: a narrow pass gives each document's different digests (20 bytes
of content each); a pre-aggregated minimum and count finds those that repeat. A
second narrow pass gives the places of units whose digest a 16 MB filter of the
repeated ones lets through, and only these are joined to them and gathered, by
document. The repeated digests are a table of their own, so Spark can split a
digest that a third of all documents hold. The texts are shuffled once, to meet
their removals.

Defined results: a null text stays null and has no units; documents that share
an id, and rows without an id, which rank last, are not compared with each
other; repeated rows (same id and text) get the same result; columns are kept,
``removed`` and ``kept`` (arrays of start and end, null where nothing goes) are
added, or replace columns of those names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._arrow import run_hashes, small_batches, splitmix, string_bytes, sub_batches, word_spans
from quillon.llm._filter import in_filter, member_filter
from quillon.session import durable

HELD = "digest_1 long, digest_2 long, rank long, n int"
#: again: where the unit starts behind its first occurrence in its own text; null at that first one.
UNITS = "digest_1 long, digest_2 long, rank long, key long, start int, end int, again int"
SPANS = "array<struct<start: int, end: int>>"
#: One of so many pairs of words is a cut in a sentence of more than ``longest`` words.
CUTS = 8
#: The rank of rows without an id.
LAST = (1 << 63) - 1
_STOPS = np.zeros(256, bool)
_STOPS[[0x21, 0x2E, 0x3F]] = True


def _runs(hashes: np.ndarray, text: np.ndarray, ends_here: np.ndarray, min_words: int, longest: int) -> np.ndarray:
    """(first word, end) of the shortest runs of sentences forward and back from every sentence."""
    if not len(hashes):
        return np.zeros((0, 2), np.int64)
    stops = np.flatnonzero(ends_here) + 1
    size = np.diff(stops, prepend=0)
    chosen = np.zeros(len(hashes), bool)
    chosen[:-1] = (splitmix(hashes[:-1] + splitmix(hashes[1:])) % np.uint64(CUTS) == 0) & (hashes[:-1] != hashes[1:])
    stops = np.flatnonzero(ends_here | (chosen & np.repeat(size > longest, size))) + 1
    starts = np.append(0, stops[:-1])
    own = text[starts]
    ahead = np.searchsorted(stops, starts + min_words)
    fits = ahead < len(stops)
    fits[fits] = own[ahead[fits]] == own[fits]
    behind = np.searchsorted(starts, stops - min_words, side="right") - 1
    reaches = behind >= 0
    reaches[reaches] = own[behind[reaches]] == own[reaches]
    return np.concatenate([np.stack([starts[fits], stops[ahead[fits]]], 1), np.stack([starts[behind[reaches]], stops[reaches]], 1)])


def units(column: pa.Array, kinds: tuple[str, ...], min_words: int, longest: int) -> tuple[np.ndarray, ...]:
    """(text number, start, end in code points, two digests) of the different units of at least ``min_words`` words."""
    data, offsets = string_bytes(column)
    hashes, starts, ends, first = word_spans(column)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    line = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
    new_text, new_line = np.ones(len(starts), bool), np.ones(len(starts), bool)
    new_text[1:] = text[1:] != text[:-1]
    new_line[1:] = new_text[1:] | (line[1:] != line[:-1])
    found = [np.zeros((0, 2), np.int64)]
    for kind in kinds:
        if kind == "run":
            ends_here = np.ones(len(starts), bool)
            ends_here[:-1] = _STOPS[data[ends[:-1] - 1]] | new_line[1:]
            found.append(_runs(hashes, text, ends_here, min_words, longest))
        elif kind in ("line", "paragraph"):
            new = new_line.copy()
            if kind == "paragraph":  # a new line that follows a blank one, or the text's first
                new[1:] &= new_text[1:] | (line[1:] - line[:-1] > 1)
            at = np.flatnonzero(new)
            upto = np.append(at[1:], len(starts))[: len(at)]
            found.append(np.stack([at, upto], 1)[upto - at >= min_words])
        else:
            raise ValueError(f"no such kind of unit: {kind}")
    spans = np.unique(np.concatenate(found), axis=0)
    at, upto = spans[:, 0], spans[:, 1]
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    own = text[at]
    base = points[offsets[own]]
    return own, points[starts[at]] - base, points[ends[upto - 1]] - base, run_hashes(hashes, at, upto), run_hashes(splitmix(hashes), at, upto)


def _grouped(column: pa.Array, kinds: tuple[str, ...], min_words: int, longest: int) -> tuple[np.ndarray, ...]:
    """The units by text, digest and place: (text, start, end, digests, whether the first of its text and digest)."""
    own, start, end, one, two = units(column, kinds, min_words, longest)
    order = np.lexsort((start, two, one, own))
    own, start, end, one, two = (x[order] for x in (own, start, end, one, two))
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return own, start, end, one, two, first


def _by_text(docs: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                yield run(batch)

    return docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64("text").alias("key"), "text").mapInArrow(each, schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of the sorted lists become one."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for spans in batch.column("removed").to_pylist():
            merged: list[dict] = []
            for s in spans:
                if merged and s["start"] < merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(s)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("key"), pa.array(out, kind)], names=["rank", "key", "removed"])


def removals(docs: DataFrame, kinds: tuple[str, ...] = ("line", "run"), min_words: int = 16, longest: int = 64) -> DataFrame:
    """(rank, key, removed): spans that go, in order; rank: the id, key: xxhash64 of the text."""
    docs = small_batches(docs)

    def hold(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, _, _, one, two, first = _grouped(batch.column("text"), kinds, min_words, longest)
        at = np.flatnonzero(first)
        n = np.diff(at, append=len(own)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), batch.column("rank").take(pa.array(own[at])), pa.array(n)], names=["digest_1", "digest_2", "rank", "n"])

    held = _by_text(docs, hold, HELD).groupBy("digest_1", "digest_2").agg(F.min("rank").alias("first"), F.sum("n").alias("n"))
    repeated = durable(held.where("n > 1").drop("n"))
    shared = docs.sparkSession.sparkContext.broadcast(member_filter(repeated.select("digest_1")))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, start, end, one, two, first = _grouped(batch.column("text"), kinds, min_words, longest)
        upto = end[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))] if len(own) else end
        again = pa.array(np.maximum(start, upto).astype(np.int32), mask=first)
        keep = np.flatnonzero(in_filter(one, shared.value))
        text = pa.array(own[keep])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64)), batch.column("rank").take(text), batch.column("key").take(text),
                pa.array(start[keep].astype(np.int32)), pa.array(end[keep].astype(np.int32)), again.take(pa.array(keep)),
            ],
            names=["digest_1", "digest_2", "rank", "key", "start", "end", "again"],
        )

    met = _by_text(docs, place, UNITS).join(repeated, ["digest_1", "digest_2"])
    later = met.select("rank", "key", F.when(F.col("first") < F.col("rank"), F.col("start")).otherwise(F.col("again")).alias("start"), "end").where("start < end")
    spans = later.groupBy("rank", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    return spans.mapInArrow(_merge, f"rank long, key long, removed {SPANS}")


def dedup(docs: DataFrame, kinds: tuple[str, ...] = ("line", "run"), min_words: int = 16, longest: int = 64) -> DataFrame:
    """The rows of ``docs`` without their repeated units, and the spans ``removed`` and ``kept`` (null: nothing was removed)."""
    gone = removals(docs, kinds, min_words, longest).select(F.col("rank").alias("g_rank"), F.col("key").alias("g_key"), F.col("removed").alias("g_removed"))
    rows = docs.select(F.struct(*docs.columns).alias("whole_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d_rank"), F.xxhash64("text").alias("d_key"))
    met = rows.join(gone, (F.col("d_rank") == F.col("g_rank")) & (F.col("d_key") == F.col("g_key")), "left")
    starts = F.concat(F.array(F.lit(0)), F.col("g_removed.end"))
    ends = F.concat(F.col("g_removed.start"), F.array(F.length("whole_row.text")))
    kept = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda s: s["end"] > s["start"])
    pieces = F.transform(kept, lambda s: F.substring(F.col("whole_row.text"), s["start"] + 1, s["end"] - s["start"]))
    text = F.when(F.col("g_removed").isNull(), F.col("whole_row.text")).otherwise(F.array_join(pieces, ""))
    columns = [text.alias(c) if c == "text" else F.col("whole_row").getField(c).alias(c) for c in docs.columns if c not in ("removed", "kept")]
    return met.select(*columns, F.col("g_removed").alias("removed"), F.when(F.col("g_removed").isNotNull(), kept).alias("kept"))
