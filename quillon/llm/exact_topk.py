"""Exact top-k search by columnar branch-and-bound.

Vectors are stored in blocks, one row of numbers per dimension (vertical
layout). For a block of queries and a block of candidates, scores grow one
group of dimensions at a time. After each group a candidate can still gain at
most |rest of query| * |rest of candidate|; those that cannot reach the query's
k-th best score so far are dropped and the survivors are compacted.

Work on Spark: every row is put in a candidate block; the stated queries, in
blocks, meet every candidate block over an equi-join on a cell of a grid,
candidate groups by query groups, so a task holds one block of each at a time.
There are about four candidate groups for each core that Spark has (as many as
blocks at most), so their number grows with the cluster; a query group is at
most ``HELD`` blocks. Only each task's best k per query are shuffled.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; only vectors of one length are compared; rows that share a vec_id
are one candidate with their best score, and none of them is a candidate of its
own query; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = "dims int, n int, ids binary, values binary"
HITS = "query_id long, vec_id long, score long"
#: Dimensions added between two rounds of pruning.
STEP = 16
ROWS = 4096
#: Blocks of queries that a task searches for at a time.
HELD = 64


def vectors(column: pa.Array, scale: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of usable rows, their lengths, flat values) of a list column; scale: floor(scale * x)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(lists.values.cast(pa.float64()).fill_null(np.nan))
    offsets = np.asarray(lists.offsets)
    starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=bad[1:])
    good = (bad[ends] == bad[starts]) & (ends > starts) & np.asarray(lists.is_valid())
    rows = np.flatnonzero(good)
    counts = (ends - starts)[rows]
    total = np.cumsum(counts) - counts
    values = flat[np.arange(int(counts.sum())) + np.repeat(starts[rows] - total, counts)]
    return rows, counts, np.floor(scale * values) if scale else values


def blocks(df: DataFrame, id_column: str, vector: str, rows: int, scale: float | None) -> DataFrame:
    """BLOCKS rows: up to ``rows`` vectors of one length, dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            usable, counts, flat = vectors(batch.column(1), scale)
            ids = np.asarray(batch.column(0))[usable]
            ends = np.cumsum(counts)
            for dims in np.unique(counts).tolist():
                own = np.flatnonzero(counts == dims)
                take = (ends[own] - dims)[:, None] + np.arange(dims)
                kept = held.setdefault(dims, ([], []))
                kept[0].append(ids[own])
                kept[1].append(flat[take])
                if sum(map(len, kept[0])) >= rows:
                    yield from _blocks(dims, *held.pop(dims), rows)
        for dims, kept in held.items():
            yield from _blocks(dims, *kept, rows)

    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long"), vector).mapInArrow(run, BLOCKS)


def _blocks(dims: int, ids: list, values: list, rows: int) -> Iterator[pa.RecordBatch]:
    ids, values = np.concatenate(ids), np.concatenate(values)
    for a in range(0, len(ids), rows):
        part = values[a : a + rows]
        cells = [[dims], [len(part)], [ids[a : a + rows].tobytes()], [np.ascontiguousarray(part.T).tobytes()]]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["dims", "n", "ids", "values"])


def _unique_best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


class Search:
    """The best k candidates so far of a block of queries."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        norms = np.square(values)
        self.rest = [np.sqrt(norms[d:].sum(axis=0)) for d in range(0, len(values) + STEP, STEP)]
        self.best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def floor(self, i: int) -> float:
        scores = self.best[i][1]
        return scores[-1] if len(scores) == self.k else -np.inf

    def meet(self, ids: np.ndarray, values: np.ndarray, rest: list[np.ndarray]) -> None:
        first = self.values[:STEP].T @ values[:STEP]
        for i, query in enumerate(self.ids.tolist()):
            scores, alive = first[i], np.flatnonzero(ids != query)
            floor = self.floor(i)
            if floor == -np.inf and len(alive) > 4 * self.k:  # a first floor from some likely candidates
                likely = alive[np.argpartition(-scores[alive], 4 * self.k)[: 4 * self.k]]
                whole = self.values[:, i] @ values[:, likely]
                found = _unique_best(ids[likely], whole, self.k)[1]
                floor = found[-1] if len(found) == self.k else floor
            partial = scores[alive]
            for step, at in enumerate(range(STEP, len(values) + STEP, STEP), 1):
                if step > 1:
                    partial = partial + self.values[at - STEP : at, i] @ values[at - STEP : at, alive]
                # the bound is rounded up by far more than its rounding error
                near = partial + self.rest[step][i] * rest[step][alive] * (1 + 1e-9) + 1e-3 >= floor
                if not near.all():
                    alive, partial = alive[near], partial[near]
                if not len(alive):
                    break
            if len(alive):
                old = self.best[i]
                self.best[i] = _unique_best(np.concatenate([old[0], ids[alive]]), np.concatenate([old[1], partial]), self.k)


def rest_norms(values: np.ndarray) -> list[np.ndarray]:
    squares = np.square(values)
    return [np.sqrt(squares[d:].sum(axis=0)) for d in range(0, len(values) + STEP, STEP)]


def top_k(df: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0, groups: int | None = None, query_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x).

    Sums are exact in double precision while they stay below 2**53, which holds
    for components up to 10**6 in thousands of dimensions.
    """
    n = df.select(F.count("*"), F.count_if(queries)).first()
    if groups is None:
        groups = max(1, min(-(-n[0] // ROWS), 4 * df.sparkSession.sparkContext.defaultParallelism))
    query_groups = max(1, -(-n[1] // (HELD * query_rows)))

    def in_groups(frame: DataFrame, own: str, own_groups: int, other: str, other_groups: int) -> DataFrame:
        placed = frame.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(own_groups)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1))))

    c = in_groups(blocks(df, id_column, vector, ROWS, scale), "grp", groups, "q_grp", query_groups).alias("c")
    q = in_groups(blocks(df.where(queries).repartition(F.col(id_column)), id_column, vector, query_rows, scale), "q_grp", query_groups, "grp", groups).alias("q")
    met = c.join(q, (F.col("c.grp") == F.col("q.grp")) & (F.col("c.q_grp") == F.col("q.q_grp")) & (F.col("c.dims") == F.col("q.dims")))
    met = met.select(F.col("q.dims"), F.col("q.ids").alias("q_ids"), F.col("q.values").alias("q_values"), F.col("c.ids"), F.col("c.values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[bytes, Search] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dims, q_ids, q_values, ids, values = (batch.column(j)[row].as_py() for j in range(5))
                search = searches.get(q_ids)
                if search is None:
                    if len(searches) >= HELD:  # keep the memory bounded
                        yield from _hits(searches)
                        searches = {}
                    search = searches[q_ids] = Search(np.frombuffer(q_ids, np.int64), np.frombuffer(q_values).reshape(dims, -1), k)
                block = np.frombuffer(values).reshape(dims, -1)
                search.meet(np.frombuffer(ids, np.int64), block, rest_norms(block))
        yield from _hits(searches)

    hits = met.mapInArrow(run, HITS).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _hits(searches: dict[bytes, Search]) -> Iterator[pa.RecordBatch]:
    for s in searches.values():
        counts = [len(b[0]) for b in s.best]
        columns = [np.repeat(s.ids, counts), np.concatenate([b[0] for b in s.best]), np.concatenate([b[1] for b in s.best]).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
