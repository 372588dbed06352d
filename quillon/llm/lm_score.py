"""Cross-entropy difference of a target and a background n-gram model.

Tokens are words (white space aside, A-Z folded, by 64-bit hash) of any script,
between a start and an end of text. Both models are word n-gram models of one
order (bigrams by default) over one vocabulary, all words of all documents. The
target's model counts the target's documents, the background's all documents.
Orders are smoothed into each other,
p(x | h) = (count(hx) + alpha p(x | shorter h)) / (count(h) + alpha), down to
one share for any word, 1 / (tokens of the corpus + 1). The models are matched:
same vocabulary, order and smoothing, and the background's counts are scaled to
the target's number of tokens. A document's score is the mean over its tokens
(its end is one) of the target's loss minus the background's loss, in nats;
lower means closer to the target.

Work on Spark: counts cover every n-gram of every document, stay distributed
and grow with the input; only three totals come to the driver. The texts are
dealt once to buckets of about ``BUCKET`` bytes by a hash of id and text. Each
bucket asks for the counts of its different n-grams (so a word that all
documents hold is asked for once by each bucket), cut into slices of the hash
range. A slice of all buckets' questions is summed in one task, and each bucket
gets its answers in the order of its questions, without the n-grams; questions
travel as differences of sorted hashes. Answers
and texts then meet by bucket. The number of buckets and slices follows from
the corpus's size, so neither grows; the texts' shuffle serves both passes.

Defined results: a null or empty text has no tokens and score 0; without any
target token all scores are 0; repeated rows are counted and scored each (those
equal in id and text share a bucket); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._arrow import SPACE, small_batches, splitmix, string_bytes, sub_batches, word_hashes

#: Bytes of text in a bucket, n-grams asked for in a slice; both about.
BUCKET, SLICE = 4 << 20, 1_500_000
BROADCAST_IDS = 1_000_000
START, END = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)
ASKED = "slice int, bucket int, grams binary, seen binary, aimed binary"
ANSWERED = "bucket int, slice int, seen binary, aimed binary"
SCORED = "doc_id long, n_tokens long, score double"


def packed(counts: np.ndarray) -> bytes:
    """64-bit counts byte by byte (all lowest bytes first), which compresses well as most are small."""
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


class Grams:
    """The n-grams of a column of texts."""

    def __init__(self, column: pa.Array, order: int):
        words, first = word_hashes(column)
        self.n = np.diff(first)
        self.lengths = np.where(self.n > 0, self.n + 2, 0)
        self.ends = np.cumsum(self.lengths)
        starts = self.ends - self.lengths
        tokens = np.empty(int(self.lengths.sum()), np.uint64)
        tokens[np.arange(len(words)) + np.repeat(starts + 1 - first[:-1], self.n)] = words
        tokens[starts[self.n > 0]], tokens[self.ends[self.n > 0] - 1] = START, END
        self.place = np.arange(len(tokens)) - np.repeat(starts, self.lengths)
        keys = [splitmix(tokens)]
        for _ in range(1, order):
            longer = np.zeros(len(tokens), np.uint64)
            longer[1:] = splitmix(keys[-1][:-1] * _FACTOR + tokens[1:])
            keys.append(longer)
        self.held = [self.place >= k for k in range(order)]  # where an n-gram lies within its text
        self.unique, self.number = np.unique(np.concatenate([x[h] for x, h in zip(keys, self.held, strict=True)]), return_inverse=True)

    def counts(self, flag: np.ndarray | None = None) -> np.ndarray:
        """How often each different n-gram occurs, in the flagged texts only if given."""
        if flag is None:
            return np.bincount(self.number, minlength=len(self.unique))
        wanted = np.repeat(flag, self.lengths)
        return np.bincount(self.number[np.concatenate([wanted[h] for h in self.held])], minlength=len(self.unique))

    def log_p(self, counts: np.ndarray, scale: float, tokens: float, floor: float, alpha: float) -> np.ndarray:
        """The log probability of the token at each place, from counts of the different n-grams."""
        found, at = counts[self.number] * scale, 0
        p = np.full(len(self.place), floor)
        context = None
        for k, held in enumerate(self.held):
            own = np.zeros(len(held))
            own[held] = found[at : at + int(held.sum())]
            at += int(held.sum())
            if k == 0:
                p = (own + alpha * p) / (tokens + alpha)
            else:
                p[1:] = np.where(held[1:], (own[1:] + alpha * p[1:]) / (context[:-1] + alpha), p[1:])
            context = own
        return np.log(p)

    def means(self, values: np.ndarray) -> np.ndarray:
        """The mean over each text's words and end."""
        total = np.zeros(len(values) + 1)
        np.cumsum(np.where(self.place > 0, values, 0), out=total[1:])
        return (total[self.ends] - total[self.ends - self.lengths]) / np.maximum(self.lengths - 1, 1)


def _flagged(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, text, is_target of every row."""
    wanted = target_ids.select(F.col("doc_id").alias("t_id")).where("t_id IS NOT NULL").distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("t_id"), "left").select("doc_id", "text", F.col("t_id").isNotNull().alias("is_target"))


def _totals(flagged: DataFrame) -> tuple[int, int, int]:
    """(bytes, tokens, the target's tokens) of all texts; a text's end is a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tokens = aimed = 0
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                data, offsets = string_bytes(batch.column("text"))
                begins = ~SPACE[data]
                edge = np.zeros(len(data) + 1, bool)
                edge[offsets] = True
                begins[1:] &= SPACE[data[:-1]] | edge[1:-1]
                before = np.zeros(len(data) + 1, np.int64)
                np.cumsum(begins, out=before[1:])
                n = before[offsets[1:]] - before[offsets[:-1]]
                n += n > 0
                size, tokens = size + len(data), tokens + int(n.sum())
                aimed += int(n[np.asarray(batch.column("is_target"))].sum())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (size, tokens, aimed)], names=["size", "tokens", "aimed"])

    sums = flagged.select("text", "is_target").mapInArrow(run, "size long, tokens long, aimed long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "tokens", "aimed")))
    return tuple(sums.first())


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def score(docs: DataFrame, target_ids: DataFrame, order: int = 2, alpha: float = 2.0) -> DataFrame:
    """doc_id, n_tokens, score of every row of ``docs``; target_ids: doc_id of the target's documents."""
    flagged = small_batches(_flagged(docs, target_ids))
    size, tokens, aimed = _totals(flagged)
    buckets, slices = 1 + size // BUCKET, 1 + order * tokens // SLICE
    edges = np.array([(i << 64) // slices for i in range(1, slices)], np.uint64)
    scale, floor = (aimed / tokens if tokens else 0.0), 1 / (tokens + 1)
    dealt = flagged.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text", "is_target")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        grams = Grams(_column(table, "text"), order)
        seen, wanted = grams.counts(), grams.counts(np.asarray(_column(table, "is_target")))
        cuts = [0, *np.searchsorted(grams.unique, edges).tolist(), len(grams.unique)]
        some = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        columns = [
            pa.array([i for i, _, _ in some], pa.int32()), pa.array([key[0].as_py()] * len(some), pa.int32()), pa.array([packed(np.diff(grams.unique[a:b], prepend=np.uint64(0))) for _, a, b in some], pa.binary()),
            pa.array([packed(seen[a:b]) for _, a, b in some], pa.binary()), pa.array([packed(wanted[a:b]) for _, a, b in some], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, names=["slice", "bucket", "grams", "seen", "aimed"])

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [np.cumsum(unpacked(x.as_buffer()).view(np.uint64)) for x in table.column("grams")]
        _, number = np.unique(np.concatenate(asked), return_inverse=True)
        sums = []
        for name in ("seen", "aimed"):
            each = np.concatenate([unpacked(x.as_buffer()) for x in table.column(name)])
            order_ = np.argsort(number, kind="stable")
            total = np.add.reduceat(each[order_], np.flatnonzero(np.append(True, np.diff(number[order_]) > 0)))
            sums.append(total[number])
        ends = np.cumsum([len(x) for x in asked]).tolist()
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        columns = [table.column("bucket").combine_chunks(), table.column("slice").combine_chunks(), *(pa.array([packed(total[a:b]) for a, b in spans], pa.binary()) for total in sums)]
        return pa.Table.from_arrays(columns, names=["bucket", "slice", "seen", "aimed"])

    def judge(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Grams(_column(texts, "text"), order)
        mean = np.zeros(len(grams.n))
        if aimed and len(grams.unique):
            answers = answers.sort_by("slice")
            seen, wanted = (np.concatenate([unpacked(x.as_buffer()) for x in answers.column(c)]) for c in ("seen", "aimed"))
            mean = grams.means(grams.log_p(seen, scale, tokens * scale, floor, alpha) - grams.log_p(wanted, 1.0, aimed, floor, alpha))
        return pa.Table.from_arrays([_column(texts, "doc_id"), pa.array(grams.n.astype(np.int64)), pa.array(mean)], names=["doc_id", "n_tokens", "score"])

    answered = dealt.groupBy("bucket").applyInArrow(ask, ASKED).groupBy("slice").applyInArrow(answer, ANSWERED)
    return dealt.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(judge, SCORED)
