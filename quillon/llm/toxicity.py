"""Toxicity by the nearest labelled examples.

A text is a TF-IDF vector over words and word beginnings (``PREFIXES`` bytes)
that the labelled examples show to be tied to label 1 (log-likelihood ratio of
at least ``least_ratio``, and ``least_lift`` times the rate of the other label, as
longer texts hold more of every common word); a text is near an example only by
such features, so a toxic text all of whose features are new to the examples is
not found. Similarity is the exact cosine. The examples stand in blocks; an
inverted list gives each feature's blocks, with the largest weight it has in
each and its postings there. The block maxima bound what any example of a block
can score, so blocks are opened in order of their bound until the bound falls
under the k-th best, and only the text's own features' postings are read.
The ``k`` nearest vote, weighted by similarity and by how often their class was
sampled; a logistic curve fitted to the leave-one-out votes of the examples
turns votes into probabilities. An example never votes on its own text, and
ties in similarity go by the examples' content, so neither ids nor the text's
own label are inputs. Texts without any such feature get the rate of label 1
among examples without one. Near copies among the examples count once, else the
words of one often copied text would look tied to its label.

The model is fitted on a bounded sample of the labelled rows: twice ``examples``
of each label are drawn by the smallest hash of their id, near copies go, and at
most ``examples`` of each label stay. All texts are scored, whole, in one narrow
pass with the model broadcast (its size is bounded by ``examples`` and
``features``); no text is shuffled.

Defined results: a null or empty text has no feature and is scored as such;
labels of null are not learned from; of repeated label rows the largest label
counts; without examples of both labels every score is 0; rows are scored each
on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._arrow import _FOLDED, Spans, list_column, small_batches, splitmix, string_bytes, sub_batches
from quillon.llm.jaccard import shingle_sets

PREFIXES = (3, 4, 5, 6)
BLOCK = 32
#: Blocks opened at a time, those of the largest bounds first.
OPENED = 8
GATE = 1 << 20
#: Bytes at a time; small enough for the processor's cache.
FEATURE_SEGMENT = 1 << 18
SCORED = "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double, label: int>>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte position, feature hash) arrays: every word (letters, digits and non-ASCII bytes) and its beginnings."""
    data, offsets = string_bytes(column)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = 0
    while at < len(data):
        end = min(at + FEATURE_SEGMENT, len(data))
        while end < len(data) and _LETTER[data[end - 1]] and _LETTER[data[end]] and not edge[end]:
            end += 1
        part = data[at:end]
        solid = _LETTER[part]
        left, right = edge[at:end].copy(), edge[at + 1 : end + 1].copy()
        left[0] = right[-1] = True
        left[1:] |= ~solid[:-1]
        right[:-1] |= ~solid[1:]
        starts, ends = np.flatnonzero(solid & left), np.flatnonzero(solid & right) + 1
        spans = Spans(part, _FOLDED)
        yield starts + at, spans.hashes(starts, ends)
        for n in PREFIXES:
            longer = starts[ends - starts > n]
            # a beginning differs from a word of the same letters
            yield longer + at, spans.hashes(longer, longer + n) ^ np.uint64(n)
        at = end


def text_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, side="right") - 1


def _log_likelihood(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Twice the log-likelihood ratio of a of n1 and b of n0 holding a feature."""
    rate = (a + b) / F.lit(n1 + n0)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    return 2 * (part(a, n1 * rate) + part(b, n0 * rate) + part(n1 - a, n1 * (1 - rate)) + part(n0 - b, n0 * (1 - rate)))


def digests(column: pa.Array) -> np.ndarray:
    """A hash of each whole text; null is empty."""
    return np.array([xxhash.xxh64_intdigest((t.as_buffer() or b"") if t.is_valid else b"") for t in column], np.uint64)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0] .. ends[0] - 1, starts[1] .. and so on."""
    counts = ends - starts
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Model:
    """The examples' inverted lists with block maxima, and the curve; small, plain arrays."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, rates: tuple[float, float], k: int):
        order = np.argsort(vocabulary)
        self.vocabulary, self.idf = vocabulary[order], idf[order]
        self.gate = np.zeros(GATE, bool)
        self.gate[(self.vocabulary & np.uint64(GATE - 1)).astype(np.int64)] = True
        self.ids, self.labels, self.rates, self.k = ids, labels, rates, k
        self.digests = np.zeros(len(ids), np.uint64)
        self.slope, self.shift, self.none = 1.0, 0.0, 0.0
        self.index([])

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, feature numbers) of those in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(self.gate[(hashes & np.uint64(GATE - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[near]
        return near[same], at[same]

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(feature numbers, weights of length 1) of each text."""
        found = [(place[at], number) for place, hashes in features(column) for at, number in [self.known(hashes)]]
        text = text_of(np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64), string_bytes(column)[1])
        number = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        cells, counts = np.unique(text * max(1, len(self.vocabulary)) + number, return_counts=True)
        text, number = np.divmod(cells, max(1, len(self.vocabulary)))
        weight = (1 + np.log(counts)) * self.idf[number]
        cuts = np.searchsorted(text, np.arange(len(column) + 1))
        return [(number[a:b], weight[a:b] / max(np.sqrt(np.square(weight[a:b]).sum()), 1e-300)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Put the examples in blocks of like texts (by strongest feature) and invert them.

        A list is a run of entries, one for each block that holds the feature:
        its largest weight in the block and its postings there.
        """
        held = np.array([i for i, (f, _) in enumerate(vectors) if len(f)], np.int64)
        keys = np.array([vectors[i][0][np.argmax(vectors[i][1])] for i in held], np.int64)
        self.order = held[np.lexsort((self.digests[held], keys))]
        place = np.repeat(np.arange(len(held)), [len(vectors[i][0]) for i in self.order])
        number = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in self.order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in self.order)])
        by_list = np.lexsort((place, number))
        self.posting_row, self.posting_weight, number = place[by_list], weight[by_list], number[by_list]
        block = self.posting_row // BLOCK
        at = np.flatnonzero(np.append(np.ones(min(1, len(number)), bool), (number[1:] != number[:-1]) | (block[1:] != block[:-1])))
        self.entry_block, self.entry_start = block[at], at
        self.entry_end = np.append(at[1:], len(number))[: len(at)]
        self.entry_most = np.maximum.reduceat(self.posting_weight, at) if len(at) else np.zeros(0)
        self.lists = np.searchsorted(number[at], np.arange(len(self.vocabulary) + 1))
        lone = np.setdiff1d(np.arange(len(vectors)), held)
        toxic, clean = (float((self.labels[lone] == v).sum()) * self.rates[v] for v in (1, 0))
        self.none = (toxic / (toxic + clean)) if toxic + clean else 0.0

    def nearest(self, number: np.ndarray, weight: np.ndarray, digest: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with any shared feature, without those of the text ``digest`` itself; ties by content."""
        starts, ends = self.lists[number], self.lists[number + 1]
        entries = _ranges(starts, ends)
        own = np.repeat(weight, ends - starts)
        by_block = np.argsort(self.entry_block[entries], kind="stable")
        entries, own = entries[by_block], own[by_block]
        blocks, first = np.unique(self.entry_block[entries], return_index=True)
        last = np.append(first[1:], len(entries))
        # rounded up by far more than the sums' rounding error
        bounds = np.add.reduceat(self.entry_most[entries] * own, first) * (1 + 1e-9) if len(first) else np.zeros(0)
        rows, scores, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        best_first = np.argsort(-bounds, kind="stable")
        for at in range(0, len(blocks), OPENED):
            opened = best_first[at : at + OPENED]
            if len(rows) >= self.k:
                opened = opened[bounds[opened] >= floor]
                if not len(opened):
                    break
            part = _ranges(first[opened], last[opened])
            from_, to = self.entry_start[entries[part]], self.entry_end[entries[part]]
            postings = _ranges(from_, to)
            places, which = np.unique(self.posting_row[postings], return_inverse=True)
            found = np.bincount(which, np.repeat(own[part], to - from_) * self.posting_weight[postings], len(places))
            near = self.order[places[found > 0]]
            found = found[found > 0]
            if digest is not None and (same := self.digests[near] == digest).any():
                near, found = near[~same], found[~same]
            rows, scores = np.concatenate([rows, near]), np.concatenate([scores, found])
            if len(rows) > self.k:
                order = self._ranked(rows, scores)[: self.k]
                rows, scores = rows[order], scores[order]
                floor = scores.min() - 1e-9
        order = self._ranked(rows, scores)
        return rows[order], scores[order]

    def _ranked(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.lexsort((self.digests[rows], -np.round(scores, 12)))

    def votes(self, rows: np.ndarray, scores: np.ndarray) -> float:
        """The log odds of label 1 among the neighbours, each voting with its cosine and class weight."""
        toxic = self.labels[rows] == 1
        return float(np.log((scores[toxic].sum() * self.rates[1] + 1e-3) / (scores[~toxic].sum() * self.rates[0] + 1e-3)))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit score = 1 / (1 + exp(-(slope * votes + shift))) to the examples' leave-one-out votes."""
        own = [i for i, (f, _) in enumerate(vectors) if len(f)]
        if not own:
            return
        x = np.array([self.votes(*self.nearest(*vectors[i], self.digests[i])) for i in own])
        y = self.labels[own].astype(float)
        w = np.where(y == 1, *self.rates[::-1])
        w = w / w.sum() * len(w)
        beta = np.array([1.0, 0.0])
        design = np.stack([x, np.ones_like(x)], axis=1)
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            gradient = design.T @ (w * (p - y)) + 1e-2 * (beta - [1.0, 0.0])
            hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            beta -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = max(float(beta[0]), 1e-3), float(beta[1])

    def score(self, rows: np.ndarray, scores: np.ndarray) -> float:
        if not len(rows):
            return self.none
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.votes(rows, scores) + self.shift, -30, 30))))

    def judged(self, column: pa.Array) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(score, examples that voted, their cosines) of each text."""
        for i, (number, weight) in enumerate(self.vectors(column)):
            found = self.nearest(number, weight, digests(column[i : i + 1])[0]) if len(number) else (np.zeros(0, np.int64), np.zeros(0))
            yield self.score(*found), *found


def _distinct(texts: DataFrame) -> set[int]:
    """The ids of sampled texts, but one of near copies: texts whose word triples have the same two least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                flat, counts = shingle_sets(batch.column("text"), 3)
                least = [[], []]
                for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    own = flat[end - n : end]
                    for kept, hashes in zip(least, (own, splitmix(own)), strict=True):
                        kept.append(int(hashes.min().view(np.int64)) if n else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in least)], names=["doc_id", "one", "two"])

    first: dict[tuple, int] = {}
    for r in sorted(texts.mapInArrow(run, "doc_id long, one long, two long").collect(), key=lambda r: r.doc_id):
        first.setdefault((r.doc_id,) if r.one is None else (r.one, r.two), r.doc_id)
    return set(first.values())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = 4000, features_kept: int = 20_000, least_ratio: float = 20.0, least_lift: float = 10.0, k: int = 15) -> Model:
    """Learn from the rows of ``labels`` (doc_id, toxic) for which ``learn`` holds."""
    known = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = dict(known.groupBy("toxic").count().collect())
    docs = small_batches(docs)
    chosen = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * examples) for v in (1, 0)]
    picked = [(r["doc_id"], r["toxic"]) for r in chosen[0].union(chosen[1]).collect()]
    if picked:
        sampled = docs.sparkSession.createDataFrame(picked, "learned long, toxic int")
        single = _distinct(docs.select("doc_id", "text").join(F.broadcast(sampled), F.col("doc_id") == F.col("learned")))
        picked = [x for v in (1, 0) for x in [(i, t) for i, t in picked if i in single and t == v][:examples]]
    taken = {v: sum(t == v for _, t in picked) for v in (0, 1)}
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), (1.0, 1.0), k)
    if not taken[0] or not taken[1]:
        return nothing
    sample = docs.sparkSession.createDataFrame(picked, "learned long, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("learned")).select("doc_id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                toxic = np.asarray(batch.column("toxic"))
                found = list(features(batch.column("text")))
                if not found:
                    continue
                text, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
                text = text_of(text, string_bytes(batch.column("text"))[1])
                order = np.lexsort((text, hashes))
                text, hashes = text[order], hashes[order]
                once = np.ones(len(text), bool)
                once[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
                text, hashes = text[once], hashes[once]
                starts = np.flatnonzero(np.append([True], hashes[1:] != hashes[:-1]))
                pos = np.add.reduceat((toxic[text] == 1).astype(np.int64), starts)
                both = np.diff(np.append(starts, len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[starts].view(np.int64)), pa.array(pos), pa.array(both - pos)], names=["feature", "pos", "neg"])

    counts = texts.mapInArrow(count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 4")
    ratio = _log_likelihood(F.col("pos"), F.col("neg"), taken[1], taken[0])
    tied = counts.where(F.col("pos") * taken[0] > F.col("neg") * taken[1] * least_lift).withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio)
    best = tied.orderBy(F.desc("ratio"), "feature").limit(features_kept).toArrow()
    vocabulary = np.asarray(best.column("feature").combine_chunks()).view(np.uint64)
    held = np.asarray(best.column("pos").combine_chunks()) + np.asarray(best.column("neg").combine_chunks())
    idf = np.log((1 + sum(taken.values())) / (1 + held)) + 1
    rates = tuple(totals[v] / taken[v] for v in (0, 1))
    model = Model(vocabulary, idf, np.zeros(0, np.int64), np.zeros(0, np.int64), rates, k)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                vectors = shared.value.vectors(batch.column("text"))
                counts = [len(f) for f, _ in vectors]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("toxic"), pa.array(digests(batch.column("text")).view(np.int64)), list_column(np.concatenate([f for f, _ in vectors]).astype(np.int32), counts, pa.int32()), list_column(np.concatenate([w for _, w in vectors]), counts, pa.float64())],
                    names=["doc_id", "toxic", "digest", "features", "weights"],
                )

    rows = texts.mapInArrow(example, "doc_id long, toxic int, digest long, features array<int>, weights array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    model.ids = np.asarray(rows.column("doc_id").combine_chunks())
    model.labels = np.asarray(rows.column("toxic").combine_chunks()).astype(np.int64)
    model.digests = np.asarray(rows.column("digest").combine_chunks()).view(np.uint64)
    vectors = [(np.array(f, np.int64), np.array(w, float)) for f, w in zip(rows.column("features").to_pylist(), rows.column("weights").to_pylist(), strict=True)]
    model.index(vectors)
    model.calibrate(vectors)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORED rows: a probability of label 1 and the neighbours that voted, for every row of ``docs``."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                scores, evidence = [], []
                for value, rows, cosines in m.judged(batch.column("text")):
                    scores.append(value)
                    evidence.append([{"doc_id": int(m.ids[r]), "similarity": float(c), "label": int(m.labels[r])} for r, c in zip(rows, cosines, strict=True)])
                kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``most``, in one narrow pass."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                scores = [value for value, _, _ in m.judged(batch.column("text"))]
                yield batch.filter(pa.array(np.array(scores) < most, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
