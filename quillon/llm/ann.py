"""Approximate nearest neighbours by balanced posting lists.

Largest inner product is nearest distance once each vector gets one more
component, sqrt(M^2 - |v|^2) for the largest norm M, and each query a zero.
Centroids come from a bounded sample, halved again and again by 2-means with
both halves of one size, so lists are balanced. A vector goes into the list of
its nearest centroid and, if it lies near a boundary, into further ones: those
at most ``1 + spread`` times as far, ``copies`` lists in all. Centroids are
searched by a best-first walk on an in-memory graph of their nearest
neighbours. A query reads the lists whose centroids are at most ``1 + reach``
times as far as its nearest one, and further ones while these hold too few
vectors, and scores what it reads exactly, in double precision. A query that
still finds fewer than k although there are more is searched over all lists.

Work on Spark: the number of lists follows from the number of vectors, up to
``most_lists``; the sample (sixteen rows a list, at least ``LEAST_SAMPLE``) and
the centroids are all that is broadcast; every row is indexed. Lists and the
queries that read them meet in blocks of at most ``ROWS`` vectors over an
equi-join on the list and its part: a list that is long by the sample's count
is split into parts of about ``PART`` blocks, and its queries go to each, so a
vector that a third of all rows have isn't one task's. Each task keeps the best
k of a query, and only those are shuffled.

Defined results: vectors that are null, empty, zero or hold a null or non-
finite component take no part, nor do rows without an id or vectors of another length than the
commonest; rows that share a vec_id are one candidate with their best score and
never their own query's; ties go to the smaller vec_id; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._arrow import splitmix
from quillon.llm.exact_topk import _unique_best, vectors
from quillon.session import durable

ROWS = 2048
#: Blocks of a list in one part.
PART = 8
LEAST_SAMPLE = 20_000
LISTED = "list int, part int, ids binary, vecs binary, n int"


def halves(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ``rows`` of one size, by 2-means."""
    own = x[rows]
    a, b = own[rng.choice(len(own), 2, replace=False)]
    half = len(own) // 2
    for _ in range(6):
        side = own @ (a - b)
        order = np.argsort(-side, kind="stable")
        a, b = own[order[:half]].mean(axis=0), own[order[half:]].mean(axis=0)
    return rows[order[:half]], rows[order[half:]]


class Index:
    """Centroids and the graph on which they are searched."""

    def __init__(self, sample: np.ndarray, lists: int, degree: int = 16):
        rng = np.random.default_rng(0)
        parts = [np.arange(len(sample))]
        while len(parts) < lists and min(map(len, parts)) >= 4:
            parts = [h for p in parts for h in halves(sample, p, rng)]
        self.centroids = np.stack([sample[p].mean(axis=0) for p in parts])
        self.squares = np.square(self.centroids).sum(axis=1)
        n = len(self.centroids)
        degree = min(degree, n - 1)
        closest = np.zeros((n, degree), np.int64)
        for at in range(0, n if degree else 0, 1024):
            near = self.squares - 2 * self.centroids[at : at + 1024] @ self.centroids.T
            near[np.arange(len(near)), at + np.arange(len(near))] = np.inf
            closest[at : at + 1024] = np.argpartition(near, degree - 1, axis=1)[:, :degree]
        far = rng.integers(0, n, (n, min(2, n - 1)))  # some far links keep the graph in one piece
        self.graph = np.concatenate([closest, far], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
        self.sizes = np.zeros(n)

    def search(self, x: np.ndarray, ef: int, squares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of about the ``ef`` nearest of each row, nearest first, by a walk on the graph."""
        n, m = len(self.centroids), len(x)
        ef = min(ef, n)
        own = np.square(x).sum(axis=1)
        pool = max(ef, len(self.entries))
        ids = np.zeros((m, pool), np.int64)
        dist = np.full((m, pool), np.inf)
        ids[:, : len(self.entries)] = self.entries
        dist[:, : len(self.entries)] = own[:, None] + self.squares[self.entries] - 2 * x @ self.centroids[self.entries].T
        seen = np.zeros((m, n), bool)
        seen[:, self.entries] = True
        opened = np.isinf(dist)
        rows = np.arange(m)
        while len(rows):
            waiting = np.where(opened[rows], np.inf, dist[rows])
            best = waiting.argmin(axis=1)
            go = np.isfinite(waiting[np.arange(len(rows)), best])
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            opened[rows, best] = True
            fresh = self.graph[ids[rows, best]]
            known = np.take_along_axis(seen[rows], fresh, axis=1)
            np.put_along_axis(seen, fresh, True, axis=1) if len(rows) == m else seen.__setitem__((rows[:, None], fresh), True)
            found = own[rows, None] + self.squares[fresh] - 2 * np.einsum("rd,rgd->rg", x[rows], self.centroids[fresh])
            found[known] = np.inf
            found[self._repeated(fresh)] = np.inf
            both, which = np.concatenate([dist[rows], found], axis=1), np.concatenate([ids[rows], fresh], axis=1)
            state = np.concatenate([opened[rows], np.isinf(found)], axis=1)
            keep = np.argpartition(both, pool - 1, axis=1)[:, :pool]
            dist[rows], ids[rows], opened[rows] = (np.take_along_axis(a, keep, axis=1) for a in (both, which, state))
        order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
        return np.take_along_axis(ids, order, axis=1), np.maximum(np.take_along_axis(dist, order, axis=1), 0)

    @staticmethod
    def _repeated(fresh: np.ndarray) -> np.ndarray:
        order = np.argsort(fresh, axis=1, kind="stable")
        ordered = np.take_along_axis(fresh, order, axis=1)
        again = np.zeros_like(fresh, bool)
        again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        out = np.zeros_like(again)
        np.put_along_axis(out, order, again, axis=1)
        return out

    def assign(self, x: np.ndarray, spread: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list and, for boundary vectors, further ones."""
        ids, dist = self.search(x, most + 4)
        rows, lists = [np.arange(len(x))], [ids[:, 0]]
        for k in range(1, min(most, ids.shape[1])):
            fits = (dist[:, k] <= (1 + spread) ** 2 * dist[:, 0]) & np.isfinite(dist[:, k])
            rows.append(np.flatnonzero(fits))
            lists.append(ids[fits, k])
        return np.concatenate(rows), np.concatenate(lists)

    def lists_of(self, x: np.ndarray, reach: float, ef: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the lists a query reads, pruned by distance ratio; while they hold under ``least`` vectors, more."""
        ids, dist = self.search(x, ef)
        held = np.cumsum(self.sizes[ids], axis=1) - self.sizes[ids]
        fits = np.isfinite(dist) & ((dist <= (1 + reach) ** 2 * np.maximum(dist[:, :1], 1e-12)) | (held < least))
        rows, at = np.nonzero(fits)
        return rows, ids[rows, at]


def _usable(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rows, counts, flat = vectors(batch.column(1), None)
    ends = np.cumsum(counts)
    own = np.flatnonzero(counts == dims)
    values = flat[(ends[own] - dims)[:, None] + np.arange(dims)]
    some = np.square(values).sum(axis=1) > 0
    return np.asarray(batch.column(0))[rows[own]][some], values[some]


def _norms(df: DataFrame, id_column: str, vector: str) -> tuple[int, float, int]:
    """(commonest length, largest norm, number of usable vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts, flat = vectors(batch.column(0), None)
            if len(counts):
                squares = np.add.reduceat(np.square(flat), np.cumsum(counts) - counts)
                for d in np.unique(counts).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([float(squares[counts == d].max())]), pa.array([int((squares[counts == d] > 0).sum())])], names=["dims", "top", "n"])

    found = df.select(vector).mapInArrow(run, "dims long, top double, n long").groupBy("dims").agg(F.max("top").alias("top"), F.sum("n").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    return (found[0]["dims"], float(np.sqrt(found[0]["top"])), found[0]["n"]) if found and found[0]["n"] else (0, 0.0, 0)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top * top - np.square(x).sum(axis=1), 0))[:, None]], axis=1)


def _in_lists(df: DataFrame, dims: int, place: Callable, parts: np.ndarray, to_all: bool) -> DataFrame:
    """LISTED rows: blocks of the vectors of each list, each vector in one part of the list or in all of them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, x = _usable(batch.slice(at, 1024), dims)
                if len(ids):
                    rows, lists = place(x)
                    n = parts[lists]
                    if to_all:
                        rows, lists, part = np.repeat(rows, n), np.repeat(lists, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    else:
                        part = (splitmix(ids[rows].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(ids[rows]), pa.array([v.tobytes() for v in x[rows]], pa.binary())], names=["list", "part", "id", "vec"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(vecs)], pa.binary()), pa.array([len(ids)], pa.int32())], names=["list", "part", "ids", "vecs", "n"])

        for batch in batches:
            for *key, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != now or len(ids) == ROWS):
                    yield out()
                    ids, vecs = [], []
                now = key
                ids.append(i)
                vecs.append(v)
        if ids:
            yield out()

    listed = df.mapInArrow(spread, "list int, part int, id long, vec binary")
    return listed.repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(block, LISTED)


def search(
    df: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", most_lists: int = 16_384,
    spread: float = 0.15, copies: int = 4, reach: float = 0.6, ef: int = 128,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``queries`` holds for."""
    schema = "query_id long, rank int, vec_id long, score double"
    df = df.where(F.col(id_column).isNotNull())
    dims, top, n = _norms(df, id_column, vector)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vec"))
    lists = int(min(most_lists, max(1, 2 ** round(np.log2(max(1.0, 2 * np.sqrt(n)))))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(LEAST_SAMPLE, 16 * lists)).toArrow()
    fitted = [_usable(b, dims)[1] for b in sample.to_batches()]
    points = np.concatenate(fitted) if fitted else np.zeros((0, dims))
    if not len(points):  # the sample held no usable vector: any one is a centroid
        points = np.ones((1, dims))
    points = _lifted(points, top)
    index = Index(points, lists)
    for at in range(0, len(points), 4096):
        np.add.at(index.sizes, index.assign(points[at : at + 4096], spread, copies)[1], n / len(points))
    parts = 1 + (index.sizes // (PART * ROWS)).astype(np.int64)
    shared = df.sparkSession.sparkContext.broadcast(index)

    def asked(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x * (top / np.sqrt(np.square(x).sum(axis=1)))[:, None], np.zeros((len(x), 1))], axis=1)

    def every_list(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(x)), len(parts)), np.tile(np.arange(len(parts)), len(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, x, asked_ids, q = (np.frombuffer(batch.column(j)[row].as_buffer(), np.int64 if j in (0, 2) else np.float64) for j in range(4))
                scores = q.reshape(-1, dims) @ x.reshape(-1, dims).T
                for i, query in enumerate(asked_ids.tolist()):
                    old = best.get(query, (np.zeros(0, np.int64), np.zeros(0)))
                    floor = old[1][-1] if len(old[0]) == k else -np.inf
                    take = np.flatnonzero((scores[i] >= floor) & (ids != query))
                    if len(take):
                        best[query] = _unique_best(np.concatenate([old[0], ids[take]]), np.concatenate([old[1], scores[i][take]]), k)
                if len(best) > 50_000:
                    yield _found(best)
                    best = {}
        if best:
            yield _found(best)

    held = _in_lists(rows, dims, lambda x: shared.value.assign(_lifted(x, top), spread, copies), parts, to_all=False)

    def nearest(asking: DataFrame, place: Callable) -> DataFrame:
        blocks = _in_lists(asking, dims, place, parts, to_all=True).select("list", "part", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
        met = held.join(blocks, ["list", "part"]).select("ids", "vecs", "q_ids", "q_vecs")
        hits = met.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return durable(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    questions = rows.where(queries)
    found = nearest(questions, lambda x: shared.value.lists_of(asked(x), reach, ef, 4 * k))
    whole = found.groupBy("query_id").agg(F.count("*").alias("held")).where(F.col("held") >= k).select(F.col("query_id").alias("id"))
    short = durable(questions.join(whole, "id", "left_anti"))
    if short.limit(1).count():  # some found fewer than k, or there are no more
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(nearest(short, every_list))
    return found.select("query_id", "rank", "vec_id", "score")


def _found(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids, scores = (np.concatenate([b[j] for b in best.values()]) for j in range(2))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), [len(b[0]) for b in best.values()])), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])
