"""Line dedup by pairwise alignment.

Lines are compared by a hash of their words (A-Z folded, white space aside);
blank lines count for nothing. A run is a shortest stretch of consecutive lines
of at least ``min_words`` words, counted forward or back from some line: rarer
than a single short line, and any block of ``min_words`` words that two
documents share is made of runs they share, whatever stands around it. A
document's partners are the first documents (by id) that hold its runs. The two
are aligned by patience diff: lines that are unique in both anchor the
alignment by their longest increasing chain, and what lies between anchors is
aligned in the same way. Stretches of aligned lines that hold at least
``min_words`` words are common blocks; so are shared runs that the alignment
leaves out because they stand in another order. Common blocks are deleted from
the later document.

So a line goes exactly if it lies in a stretch of consecutive lines of at least
``min_words`` words that some document with a smaller id holds too, however
many do: a block that has lost its first holder as a partner has it by another
of its runs.

Work on Spark: a narrow pass makes line hashes, which a checkpoint keeps (about
16 bytes a line). Documents of equal lines are collapsed first. Each run's
occurrence makes one pair at most, (document, first holder), so a line that a
third of all documents hold makes pairs in proportion to them, never their
square; the first holders are a table of their own, so that Spark can split the
join of a hot run. Only hashes go through the pair joins; the texts are
shuffled once, to meet their deletions.

Defined results: a null text stays null; blank lines stay unless a text loses
all its other lines; rows without an id are left alone; rows that share an id
are not compared with each other; repeated rows get the same result; columns
are kept (``removed``, the deleted line numbers from 0, is added last, or
replaces a column of that name); an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._arrow import list_column, run_hashes, small_batches, splitmix, string_bytes, sub_batches, word_spans
from quillon.session import durable

LINES = "doc_id long, key long, digest_1 long, digest_2 long, lines array<long>, words array<int>, numbers array<int>"


def line_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, line number of every line with words; how many such lines each text has)."""
    data, offsets = string_bytes(column)
    hashes, starts, _, first = word_spans(column)
    breaks = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(breaks, starts)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(starts))
    before = np.searchsorted(breaks, offsets[:-1])
    return run_hashes(hashes, at, ends), ends - at, line[at] - before[text[at]], np.bincount(text[at], minlength=len(column))


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of positions, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        mine, theirs = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {x: y for y, x in enumerate(b[j:j_end], j) if theirs[x] == 1}
        tops: list[int] = []  # patience: the piles' top cards, and for each card the one under it
        cards: list[tuple] = []
        for x in range(i, i_end):
            y = place.get(a[x]) if mine[a[x]] == 1 else None
            if y is None:
                continue
            pile = bisect_left(tops, y)
            card = (x, y, cards[pile - 1] if pile else None)
            if pile == len(tops):
                tops.append(y)
                cards.append(card)
            else:
                tops[pile], cards[pile] = y, card
        if not cards:
            continue
        anchors, card = [], cards[-1]
        while card:
            anchors.append(card[:2])
            card = card[2]
        x, y = i, j
        for p, q in anchors[::-1]:
            todo.append((x, p, y, q))
            out.append((p, q))
            x, y = p + 1, q + 1
        todo.append((x, i_end, y, j_end))
    return sorted(out)


def runs(words: np.ndarray, text: np.ndarray, min_words: int) -> np.ndarray:
    """(first line, end) of the shortest runs of ``min_words`` words forward and back from every line; text: whose line it is."""
    if not len(words):
        return np.zeros((0, 2), np.int64)
    upto = np.cumsum(words)
    before = upto - words
    end = np.searchsorted(upto, before + min_words)
    fits = end < len(upto)
    fits[fits] = text[end[fits]] == text[fits]
    start = np.searchsorted(before, upto - min_words, side="right") - 1
    reaches = start >= 0
    reaches[reaches] = text[start[reaches]] == text[reaches]
    ahead = np.stack([np.flatnonzero(fits), end[fits] + 1], 1)
    return np.unique(np.concatenate([ahead, np.stack([start[reaches], np.flatnonzero(reaches) + 1], 1)]), axis=0)


def common_blocks(a: list, b: list, words: list[int], min_words: int) -> list[int]:
    """Positions in ``a`` of its common blocks with ``b``: aligned ones, and shared runs that stand in another order."""
    gone: set[int] = set()
    block: list[int] = []
    last = None
    for i, j in [*_aligned(a, b), (None, None)]:
        if last is not None and i is not None and (i, j) == (last[0] + 1, last[1] + 1):
            block.append(i)
        else:
            if sum(words[k] for k in block) >= min_words:
                gone.update(block)
            block = [i]
        last = (i, j)
        if i is None:
            break
    left = [(i, j) for i, j in runs(np.array(words), np.zeros(len(a)), min_words).tolist() if not gone.issuperset(range(i, j))]
    if left:
        size = dict(zip(a, words, strict=True))
        known = [x in size for x in b]
        # lines that ``a`` doesn't hold end a run of ``b``
        held = runs(np.array([size.get(x, min_words) for x in b]), np.cumsum(np.logical_not(known)), min_words).tolist()
        theirs = {tuple(b[i:j]) for i, j in held if all(known[i:j])}
        for i, j in left:
            if tuple(a[i:j]) in theirs:
                gone.update(range(i, j))
    return sorted(gone)


def _lines(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                hashes, words, numbers, counts = line_units(batch.column("text"))
                ends = np.cumsum(counts)
                digest = run_hashes(hashes, ends - counts, ends), run_hashes(splitmix(hashes), ends - counts, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("key"), *(pa.array(d.view(np.int64)) for d in digest), list_column(hashes.view(np.int64), counts, pa.int64()),
                        list_column(words.astype(np.int32), counts, pa.int32()), list_column(numbers.astype(np.int32), counts, pa.int32()),
                    ],
                    names=["doc_id", "key", "digest_1", "digest_2", "lines", "words", "numbers"],
                )

    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(run, LINES).where(F.size("lines") > 0)


def removals(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """(doc_id, key, removed): the line numbers that go, for documents that lose some; key: xxhash64 of the text."""
    lines = durable(_lines(small_batches(docs)))
    words = F.aggregate("words", F.lit(0), lambda a, x: a + x)
    alike = lines.groupBy("digest_1", "digest_2").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    ranked = lines.join(durable(alike), ["digest_1", "digest_2"], "left")
    whole = ranked.where((F.col("doc_id") > F.col("first_id")) & (words >= min_words)).select("doc_id", "key", F.col("numbers").alias("removed"))
    single = ranked.where("first_id IS NULL OR doc_id = first_id").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "lines", "words", "numbers")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(np.asarray(batch.column("lines").offsets))
            hashes = np.asarray(batch.column("lines").flatten()).view(np.uint64)
            text = np.repeat(np.arange(batch.num_rows), counts)
            spans = runs(np.asarray(batch.column("words").flatten()), text, min_words)
            own, unit = text[spans[:, 0]], run_hashes(hashes, spans[:, 0], spans[:, 1])
            once = np.unique(np.stack([own.astype(np.uint64), unit], 1), axis=0)
            take = pa.array(once[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(once[:, 1].copy().view(np.int64))], names=["doc_id", "key", "unit"])

    posted = single.select("doc_id", "key", "lines", "words").mapInArrow(post, "doc_id long, key long, unit long")
    # of texts that share the first id any may be the owner: what it shares by the run is the same
    owners = posted.groupBy("unit").agg(F.min("doc_id").alias("owner_id"), F.min_by("key", "doc_id").alias("owner_key"), F.max("doc_id").alias("last_id")).where("owner_id < last_id").drop("last_id")
    pairs = posted.join(durable(owners), "unit").where("owner_id < doc_id").select("doc_id", "key", "owner_id", "owner_key").distinct()
    early = single.select(F.col("doc_id").alias("owner_id"), F.col("key").alias("owner_key"), F.col("lines").alias("theirs"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for row in batch.select(["lines", "words", "numbers", "theirs"]).to_pylist():
                gone.append([row["numbers"][i] for i in common_blocks(row["lines"], row["theirs"], row["words"], min_words)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "key", "removed"])

    both = pairs.join(early, ["owner_id", "owner_key"]).join(single, ["doc_id", "key"]).select("doc_id", "key", "lines", "words", "numbers", "theirs")
    parts = both.mapInArrow(align, "doc_id long, key long, removed array<int>").where(F.size("removed") > 0)
    merged = parts.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))
    return merged.union(whole.dropDuplicates(["doc_id", "key"]))


def dedup(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """The rows of ``docs`` with common blocks deleted from ``text``, and ``removed`` (null: nothing)."""
    gone = removals(docs, min_words).select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), F.col("removed").alias("g_removed"))
    rows = docs.select(F.struct(*docs.columns).alias("whole_row"), F.col("doc_id").cast("long").alias("d_id"), F.xxhash64("text").alias("d_key"))
    met = rows.join(gone, (F.col("d_id") == F.col("g_id")) & (F.col("d_key") == F.col("g_key")), "left")
    kept = F.filter(F.split("whole_row.text", "\n"), lambda x, i: ~F.array_contains("g_removed", i))
    blank = ~F.exists(kept, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(F.col("g_removed").isNull(), F.col("whole_row.text")).when(blank, F.lit("")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col("whole_row").getField(c).alias(c) for c in docs.columns if c != "removed"]
    return met.select(*columns, F.col("g_removed").alias("removed"))
