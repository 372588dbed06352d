"""Ranked lexical search: impact-ordered postings, score at a time.

The terms of a text are the maximal runs of ASCII letters and digits and of
all characters beyond ASCII, A-Z in lower case. A document's score for an item
is the sum, over the item's terms with repeats, of

    weight(term) * impact(term, document)
    weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))
    impact = 10^9 tf div (1000 tf + 12 m),  m = 100 - 25 + (25 n N) div L

Work on Spark: one scan of all documents keeps, per document, its length and
the occurrences of the items' terms; N, L and df are aggregates of that. Then
every task cuts its documents into blocks of about ``block`` postings and
orders each term's postings by exact impact, descending. An item is answered
score at a time: all groups of postings whose contribution reaches a level are
added to the accumulators, then those of the next level, from the highest
down. What each list still holds bounds what a document can gain. Once no more
than 2 k documents can reach the k-th score (of this block or of an earlier one
of the task), no other can be among the k best: these documents' scores are
completed from their own postings. Else the lists are read to the end. Each
task gives k documents an item, and a window ranks those of all tasks.

Items come in blocks of about ``item_bytes`` of text, which bounds what is sent
to the tasks; documents are only ever split by rows, so no term, copy or
source makes a hot group. Terms are told apart by 64-bit hashes.

Defined results: a null or empty text has no terms; an item without terms has
no rows. Repeated document rows are documents each; a document without an id is
ranked behind those of equal score that have one. Repeated item rows are items
each, with equal rows. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._arrow import gathered, list_column, small_batches, sub_batches, word_spans
from quillon.session import durable

#: Bytes that are no part of a term.
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term in order, index of each text's first term and the end)."""
    hashes, _, _, first = word_spans(texts, space=BETWEEN)
    return hashes, first


class Items:
    """A block of items: their ids, the sorted different terms, and each item's (term number, occurrences)."""

    def __init__(self, ids: list, texts: list[str | None]):
        hashes, first = terms(pa.array(texts, pa.string()))
        self.ids = ids
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        self.terms = [np.unique(number[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (all terms) and the numbers and occurrences of the vocabulary's terms, for every document with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, "text"):
                hashes, first = terms(part.column("text"))
                n = np.diff(first)
                slot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[slot] == hashes
                key, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(vocabulary) + slot[hit], return_counts=True)
                held = np.bincount(key // len(vocabulary), minlength=len(n))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), list_column((key % len(vocabulary)).astype(np.int32), held, pa.int32()), list_column(tf.astype(np.int32), held, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Block:
    """Some documents' postings, by document and by (term, impact descending)."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int, terms_in_all: int):
        m = 100 - 25 + (25 * lengths * n_docs) // n_terms
        doc = np.repeat(np.arange(len(lengths)), counts)
        self.term, self.first = term, np.concatenate([[0], np.cumsum(counts)])
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
        order = np.lexsort((-self.impact, term))
        self.doc, self.falling = doc[order], self.impact[order]
        self.list = np.searchsorted(term[order], np.arange(terms_in_all + 1))
        self.size = len(lengths)

    def best(self, numbers: np.ndarray, weights: np.ndarray, by_term: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that may be among the k best and reach ``floor``; by_term: scratch of zeros."""
        held = [(int(self.list[t]), int(self.list[t + 1]), int(w)) for t, w in zip(numbers, weights, strict=True) if w and self.list[t] < self.list[t + 1]]
        gained = np.zeros(self.size, np.int64)
        heads = [w * int(self.falling[at]) for at, _, w in held]
        while (left := sum(heads)) > 0:
            level = max(1, max(heads) // 4)
            for i, (at, end, w) in enumerate(held):
                if heads[i] >= level:
                    stop = at + int(np.searchsorted(-self.falling[at:end], -(-(-level // w)), side="right"))
                    gained[self.doc[at:stop]] += w * self.falling[at:stop]
                    held[i] = (stop, end, w)
                    heads[i] = w * int(self.falling[stop]) if stop < end else 0
            left = sum(heads)
            kth = int(np.partition(gained, self.size - k)[self.size - k]) if self.size > k else 0
            bound = max(floor, kth, 1)
            if left < bound and np.count_nonzero(gained >= bound - left) <= 2 * k:
                break
        if not left:
            found = np.flatnonzero(gained >= max(floor, 1))
            return found, gained[found]
        found = np.flatnonzero(gained >= bound - left)
        by_term[numbers] = weights
        scores = np.array([np.dot(by_term[self.term[a:b]], self.impact[a:b]) for a, b in zip(self.first[found], self.first[found + 1], strict=True)], np.int64)
        by_term[numbers] = 0
        return found, scores


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Runs of documents with about ``block`` postings, one document at least."""
    held, size = [], 0
    for batch in batches:
        ends = np.asarray(batch.column("terms").offsets).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + block - size, side="right")) - 1)
            held.append(batch.slice(at, end - at))
            size += int(ends[end] - ends[at])
            at = end
            if size >= block or at < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _best_of_tasks(found: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_terms: int, k: int, block: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nobody = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        top = [nobody] * len(items.terms)
        by_term = np.zeros(len(weight), np.int64)
        for part in _blocks(batches, block):
            column = part.column("terms")
            counts = np.diff(np.asarray(column.offsets))
            number, tf = np.asarray(column.flatten()).astype(np.int64), np.asarray(part.column("tf").flatten()).astype(np.int64)
            index = Block(np.asarray(part.column("n")), counts, number, tf, n_docs, n_terms, len(weight))
            no_id = np.asarray(part.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            ids = np.asarray(part.column("doc_id").fill_null(0))
            for i, (numbers, times) in enumerate(items.terms):
                floor = int(top[i][2][-1]) if len(top[i][2]) == k else 0
                docs, scores = index.best(numbers, weight[numbers] * times, by_term, k, floor)
                if len(docs):
                    id_, none, score = (np.concatenate(x) for x in zip(top[i], (ids[docs], no_id[docs], scores), strict=True))
                    first = np.lexsort((id_, none, -score))[:k]
                    first = first[score[first] > 0]
                    top[i] = (id_[first], none[first], score[first])
        for i, (id_, none, score) in enumerate(top):
            if len(id_):
                columns = [pa.array(np.full(len(id_), i), pa.int32()), pa.array([items.ids[i]] * len(id_), pa.int64()), pa.array(id_, pa.int64(), mask=none), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])

    return found.mapInArrow(lambda batches: gathered(run(batches)), "item int, item_id long, doc_id long, score long")


def _search(docs: DataFrame, items: Items, k: int, block: int) -> DataFrame:
    found = durable(postings(docs, items.vocabulary))
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    for number, count in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each term of the items
        df[number] = count
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    return _best_of_tasks(found, items, weight, n_docs, max(n_terms, 1), k, block)


def rank(docs: DataFrame, items: DataFrame, k: int = 20, block: int = 1 << 20, item_bytes: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = 1 + size // item_bytes
    each = []
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        block_of = Items([r.item_id for r in rows], [r.text for r in rows])
        if len(block_of.vocabulary):
            each.append(_search(docs, block_of, k, block).withColumn("part", F.lit(part)))
    if not each:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("part", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionAll, each).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
