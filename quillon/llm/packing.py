"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of token streams. A window of ``window`` tokens gives
every source a quantum, its share of the target proportions among the queues
that still hold tokens; a source is served the whole tokens of its deficit, and
what is left of the window goes one token at a time to the largest deficits.
Deficits carry from window to window. Windows fall into blocks that tasks plan
alone: the state at a block's edge has a closed form (how far each queue has
come at that point of the fluid schedule), and the last window of a block pays
out what the block owes, so deficits also carry from block to block and from
partition to partition. Every window but the last is full.

Work on Spark: one narrow pass encodes the texts and notes each document's
place within its partition and source; a reliable checkpoint keeps the ids; a
small aggregate turns (source, partition) token counts into stream offsets; a
second narrow pass cuts the documents. Token ids are not shuffled while the
offsets (one row for each source and partition) are few enough to broadcast, a
checked number; beyond ``BROADCAST_ROWS`` they are, once, to meet them.

Defined results: a null text is empty (its ids are the end id alone); a null
source is a queue of its own, last in the round; repeated rows are packed as
often as they occur; an empty table gives no pieces; other columns are ignored.
The ``own_queues`` largest sources are queues of their own, as are those that
``weights`` names; any smaller ones share ``SHARED`` queues by a hash of their
name, with their weights summed, one source after the other within a queue.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._arrow import small_batches, sub_batches
from quillon.session import durable

TOKENS = "doc_id long, source string, part int, local_start long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Windows planned together; rows of a plan are windows, columns sources.
BLOCK = 256
#: Rows of the (source, partition) offset table that are still broadcast.
BROADCAST_ROWS = 200_000
#: Queues for the sources beyond ``own_queues``.
SHARED = 64


#: Fixed value: the vocabulary's special token, which is one id also where a text spells it out.
SPECIAL = (("<|endoftext|>", 50256),)


@lru_cache(maxsize=1)
def _encoder(ranks_path: str, pattern: str):
    from quillon.llm._bpe import Encoder

    return Encoder(ranks_path, pattern, SPECIAL)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, end_id: int) -> DataFrame:
    """TOKENS rows: each document's ids (little-endian 16 bit) and its place in its partition's stream of its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ahead = _encoder(ranks_path, pattern), TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                sources = batch.column("source").to_pylist()
                ids = [np.append(x, end_id).astype("<u2") for x in encoder.encode(texts)]
                starts = []
                for source, x in zip(sources, ids, strict=True):
                    starts.append(ahead.get(source, 0))
                    ahead[source] = starts[-1] + len(x)
                columns = [batch.column("doc_id"), batch.column("source"), [part] * len(ids), starts, [len(x) for x in ids], [x.tobytes() for x in ids]]
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "source", "part", "local_start", "n_tokens", "ids"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, TOKENS)


class Schedule:
    """Where each queue's tokens go. held: tokens by queue; weights: target shares."""

    def __init__(self, held: list[int], weights: list[float], window: int):
        self.held, self.window = np.asarray(held, np.int64), window
        share = np.asarray(weights, float)
        self.share = share / share.sum()
        self.total = int(self.held.sum())
        self.windows = -(-self.total // window)
        self._plans: OrderedDict[int, np.ndarray] = OrderedDict()
        self._edges: OrderedDict[int, tuple[np.ndarray, float]] = OrderedDict()

    def _counts(self, v: float) -> np.ndarray:
        return np.minimum(self.held, np.floor(self.share * v + 0.5).astype(np.int64))

    def edge(self, tokens: int) -> tuple[np.ndarray, float]:
        """(tokens served by queue, fluid time) once ``tokens`` in all are served; grows with ``tokens``."""
        tokens = min(tokens, self.total)
        if tokens in self._edges:
            return self._edges[tokens]
        low, high = 0.0, float(max(1.0, (self.held / self.share).max() + 1 / self.share.min()))
        while (middle := (low + high) / 2) not in (low, high):
            if self._counts(middle).sum() <= tokens:
                low = middle
            else:
                high = middle
        served, upper = self._counts(low), self._counts(high)
        for i in np.flatnonzero(upper > served):
            served[i] += min(int(upper[i] - served[i]), tokens - int(served.sum()))
        if tokens == self.total:
            served = self.held.copy()
        self._edges[tokens] = served, low
        if len(self._edges) > 512:
            self._edges.popitem(last=False)
        return served, low

    def plan(self, block: int) -> np.ndarray:
        """Row w: tokens each queue has been served before window w of the block; the last row ends the block."""
        if block in self._plans:
            self._plans.move_to_end(block)
            return self._plans[block]
        size = BLOCK * self.window
        (served, time), (end, _) = self.edge(block * size), self.edge((block + 1) * size)
        windows = -(-int(end.sum() - served.sum()) // self.window)
        rows = np.empty((windows + 1, len(self.held)), np.int64)
        rows[0], rows[-1] = served, end
        deficit = np.minimum(self.held, self.share * time) - served
        done = served.copy()
        for w in range(1, windows):
            left = end - done
            open_ = left > 0
            deficit += np.where(open_, self.share, 0) * (self.window / self.share[open_].sum())
            serve = np.clip(np.floor(deficit).astype(np.int64), 0, left)
            room = self.window - int(serve.sum())
            if room < 0:  # deficits summed to more than a window: the smallest wait
                for i in np.argsort(deficit - serve, kind="stable"):
                    back = min(-room, int(serve[i]))
                    serve[i] -= back
                    room += back
            while room > 0:
                able = np.flatnonzero(left > serve)
                order = able[np.argsort(-(deficit - serve)[able], kind="stable")][:room]
                serve[order] += 1
                room -= len(order)
                if room > len(able) > 0:  # few queues are left: share out what they can hold
                    extra = np.minimum((left - serve)[able], room // len(able))
                    serve[able] += extra
                    room -= int(extra.sum())
            deficit -= serve
            done = done + serve
            rows[w] = done
        self._plans[block] = rows
        if len(self._plans) > max(4, 4_000_000 // rows.size):
            self._plans.popitem(last=False)
        return rows

    def block_of(self, queue: int, position: int) -> int:
        """The block that serves the queue's token at ``position``."""
        time = (position + 0.5) / self.share[queue]
        block = int(np.minimum(self.held, self.share * time).sum() // (BLOCK * self.window))
        while block and self.edge(block * BLOCK * self.window)[0][queue] > position:
            block -= 1
        while self.edge((block + 1) * BLOCK * self.window)[0][queue] <= position:
            block += 1
        return block

    def cuts(self, queue: int, position: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, offset in it, length) of the pieces of a document at ``position`` of its queue."""
        end = position + length
        while position < end:
            block = self.block_of(queue, position)
            rows = self.plan(block)
            column = rows[:, queue]
            a = int(np.searchsorted(column, position, side="right")) - 1
            b = int(np.searchsorted(column, end, side="left"))
            b = min(b, len(column) - 1)
            stops = np.minimum(column[a + 1 : b + 1], end)
            starts = np.concatenate([[position], stops[:-1]])
            some = stops > starts
            w = np.arange(a, b)[some]
            before = (rows[w + 1, :queue] - rows[w, :queue]).sum(axis=1)
            yield block * BLOCK + w, before + starts[some] - column[w], (stops - starts)[some]
            position = int(stops[-1])


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    window: int = 2048,
    end_id: int = 1,
    weights: dict[str | None, float] | None = None,
    own_queues: int = 2000,
) -> DataFrame:
    """PIECES rows: where each stretch of each document's ids goes.

    ``docs`` has doc_id, source and text. ``weights``: target token shares by
    source; by default each source's own share of the tokens, so that every
    window shows the corpus's mixture and all queues end together. Ids must fit
    16 bits (vocabularies up to 65,536).
    """
    spark = small_batches(docs).sparkSession
    tokens = durable(tokenize(docs, ranks_path, pattern, end_id))
    parts = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    if weights is None:
        largest = parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.col("source").asc_nulls_last()).limit(own_queues).collect()
        own = [r["source"] for r in largest]
    else:
        own = list(weights)
    own = sorted(own, key=lambda s: (s is None, s or ""))
    named = spark.createDataFrame([(s, i) for i, s in enumerate(own)], "own_source string, own int")
    of_queue = F.coalesce("own", len(own) + F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("int")).alias("queue")
    parts = parts.join(F.broadcast(named), parts.source.eqNullSafe(named.own_source), "left").select("source", "part", "n", of_queue)
    sums = parts.groupBy("queue").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).orderBy("queue").collect()
    if not sums:
        return spark.createDataFrame([], PIECES)
    if weights is not None and sums[-1]["queue"] >= len(own):
        raise ValueError("each source needs a weight")
    held = [r["n"] for r in sums]
    shares = [float(n) for n in held] if weights is None else [float(weights[own[r["queue"]]]) for r in sums]
    if min(shares) <= 0:
        raise ValueError("each source needs a positive weight")
    within = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("of_source"), F.col("part").alias("of_part"), "queue", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("part_start"))
    if sum(r["rows"] for r in sums) <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = tokens.join(starts, tokens.source.eqNullSafe(starts.of_source) & (tokens.part == starts.of_part)).select("doc_id", "queue", (F.col("part_start") + F.col("local_start")).alias("position"), "ids")
    queue_of = {r["queue"]: i for i, r in enumerate(sums)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(held, shares, window)
        for batch in batches:
            rows, parts = [[], [], [], []], [[], [], []]
            for doc, queue, position, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                start, n = 0, len(wide) // 4
                for found in schedule.cuts(queue_of[queue], position, n):
                    for kept, x in zip(parts, found, strict=True):
                        kept.append(x)
                    for length in found[2].tolist():
                        rows[0].append(doc)
                        rows[1].append(start)
                        rows[2].append(zlib.crc32(wide[4 * start : 4 * (start + length)]))
                        rows[3].append(n)
                        start += length
                if len(rows[0]) > 200_000:
                    yield _pieces(rows, parts)
                    rows, parts = [[], [], [], []], [[], [], []]
            if rows[0]:
                yield _pieces(rows, parts)

    return placed.mapInArrow(run, PIECES)


def _pieces(rows: list[list], parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    window, offset, length = (np.concatenate(x) for x in parts)
    columns = [rows[0], rows[1], length, rows[2], rows[3], window, offset]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
