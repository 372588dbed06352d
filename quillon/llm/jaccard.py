"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its word shingles, as 64-bit hashes. Two documents of
x and y shingles link when their overlap reaches T = ceil(p (x + y) / (100 + p))
for p percent similarity. DivideSkip splits a document's inverted lists into
long ones and short ones: the T - 1 lists that come last in a common order
(frequent shingles last) are never merged, so a partner must occur in a short
list. Short lists are merged by Spark's sort (postings sorted by shingle, pairs
counted over lists), pairs whose count cannot reach T any more are dropped, and
the long lists of the rest are probed by binary search in the partner's set.

Hot lists: texts with equal sets are collapsed first, so copies make one
posting. A list of fewer than ``long_list`` postings gives all its pairs. In a
longer one each document meets its neighbour and the head of its list only; the
head is the document with the most frequent shingles, as a rule the text that
others were copied from. The links found so far make components. What is left
are pairs of different components that share no short list but long ones: they
need all of T's short part from long lists, which each of the two must have in
its own prefix and, by counts per list and size, some partner too. Only such
documents meet again: in a list with fewer than ``long_list`` documents besides
its largest component, each of these meets all others.

Longer lists, as of many variants of one text that lie just below p percent of
each other, are taken by references. A list's reference R is its member of most
such lists; every member X is compared with it and becomes the set of its
differences from R, of d(X) shingles. For any R, X and Y link when they share
(d(X) + d(Y) - x - y) / 2 + T differences or more. That is at least 1 unless
both link with R, and at least d(X) less what two linked texts may differ in,
x (100 - p) / p. So a prefix of that many differences and one, rare ones first,
holds a shared one. Lists of differences that are long again (four times
``long_list``) get references of their own, without the first one, and so on;
what is left after ``ROUNDS`` gives all its pairs. No link is lost, and a group of near copies, linked or
not, does not emit its pairs as long as its members differ in different places.

The order needs to know which shingles are frequent; those held by ``often``
documents or more are broadcast, the most frequent first, at most
``most_often`` of them (9 bytes each). Their lists are split by document size
and, when very long, into parts of about ``PART`` postings. The set only orders
and splits: a list outside it that turns out long when it is read is a long
list all the same, so the bound on the set costs time, never a link. A filter
of the documents that occur in pairs is broadcast too (16 MB at any size).

Defined results: a null or empty text has no shingles and links with nothing;
a text of fewer words than n is one shingle, the whole sequence; rows that
share a doc_id are one document, which links by any of its texts (n_shingles is
each row's own); a row without an id gets no component; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._arrow import gathered, list_column, small_batches, splitmix, sub_batches, word_hashes
from quillon.llm._filter import in_filter, member_filter
from quillon.llm.components import components
from quillon.session import durable

PREFIXES = "doc_id long, n int, digest_1 long, digest_2 long, small array<long>, small_often int, large array<long>, large_often int"
#: A pair (a, b) of a list; or, with a shingle, a posting of document a in a long list that was not known as frequent.
MET = "a long, b long, light int, need int, star int, shingle long, large byte, n int"
SETS = "doc_id long, part long, n int, shingles binary"
DIFFERENCES = "path long, doc_id long, part long, label long, head long, linked boolean, n int, size int, differences array<long>"
#: Documents of more shingles count a quarter of them, those with small hashes, which come first in their order; the rest
#: is counted only for those that hold too few infrequent ones of small hash.
SMALL = 160
LOW = np.uint64(1 << 62)
#: Postings of a frequent shingle that stay one list.
PART = 200_000
#: How often long lists of differences get references of their own.
ROUNDS = 6
_FACTORS = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one after the other; how many of each)."""
    words, first = word_hashes(column)
    lengths = np.diff(first)
    if len(words) >= n:
        rolled = words[: len(words) - n + 1].copy()
        for j in range(1, n):
            rolled = rolled * _FACTORS[j % len(_FACTORS)] + words[j : len(words) - n + 1 + j]
        rolled = splitmix(rolled)
    sets, counts = [], np.zeros(len(lengths), np.int64)
    for i, (start, length) in enumerate(zip(first[:-1].tolist(), lengths.tolist(), strict=True)):
        if length >= n:
            own = np.unique(rolled[start : start + length - n + 1])
        elif length:
            own = np.uint64(length)
            with np.errstate(over="ignore"):
                for w in words[start : start + length]:
                    own = own * _FACTORS[0] + w
            own = splitmix(np.array([own], np.uint64))
        else:
            continue
        sets.append(own)
        counts[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def _by_text(docs: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "text"):
                if (out := run(batch)) is not None:
                    yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema)


def _record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names.split())


def _counted(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(shingle, held): how many documents hold it; all shingles of small documents, those of small hash of the others."""
    reach = SMALL * 100 // percent

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = shingle_sets(batch.column("text"), n)
        keep = (flat < LOW) | np.repeat(counts <= reach, counts)
        shingles, held = np.unique(flat[keep], return_counts=True)
        return _record("shingle held", pa.array(shingles.view(np.int64)), pa.array(held.astype(np.int64)))

    return _by_text(docs, run, "shingle long, held long").groupBy("shingle").agg(F.sum("held").alias("held"))


def _most_frequent(counted: DataFrame, often: int, most_often: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the most frequent shingles counted, at most ``most_often``."""
    frequent = durable(counted.where(F.col("held") >= often))
    level = F.floor(F.log2("held")).cast("int")
    histogram = dict(frequent.groupBy(level.alias("level")).count().collect())
    total, least = 0, 64
    for k in sorted(histogram, reverse=True):
        total += histogram[k]
        if total > most_often:
            break
        least = k
    rows = frequent.where(level >= least).toArrow()
    shingles = np.asarray(rows.column("shingle").combine_chunks()).astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.asarray(rows.column("held").combine_chunks()).astype(np.int64)[order]


def _rest_counted(docs: DataFrame, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """(shingle, held) of large hash, over the large documents that don't hold enough infrequent ones of small hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = shingle_sets(batch.column("text"), n)
        plain = (flat < LOW) & ~_is_in(flat, shared.value)
        before = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(plain, out=before[1:])
        ends = np.cumsum(counts)
        few = (counts > SMALL) & (before[ends] - before[ends - counts] < counts - -(-percent * counts // 100) + 1)
        shingles, held = np.unique(flat[np.repeat(few, counts) & (flat >= LOW)], return_counts=True)
        return _record("shingle held", pa.array(shingles.view(np.int64)), pa.array(held.astype(np.int64)))

    return _by_text(docs, run, "shingle long, held long").groupBy("shingle").agg(F.sum("held").alias("held"))


def _often(docs: DataFrame, n: int, percent: int, often: int, most_often: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of frequent shingles, into how many parts each one's lists are split); at most twice ``most_often``."""
    shingles, held = _most_frequent(_counted(docs, n, percent), often, most_often)
    shared = docs.sparkSession.sparkContext.broadcast(shingles)
    more, also = _most_frequent(_rest_counted(docs, n, percent, shared), often, most_often)
    shared.destroy()
    shingles, at = np.unique(np.concatenate([shingles, more]), return_index=True)
    return shingles, np.minimum(np.concatenate([held, also])[at] // PART + 1, 1 << 15).astype(np.uint16)


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _prefixes(docs: DataFrame, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """PREFIXES rows: a document's short lists, in the order of small documents and of large ones."""
    reach = SMALL * 100 // percent

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, counts = shingle_sets(batch.column("text"), n)
        frequent, mixed = _is_in(flat, shared.value[0]), splitmix(flat)
        ends = np.cumsum(counts)
        prefixes: dict[bool, list] = {True: [], False: []}
        heavy = {True: np.zeros(len(counts), np.int32), False: np.zeros(len(counts), np.int32)}
        lengths = {True: np.zeros(len(counts), np.int64), False: np.zeros(len(counts), np.int64)}
        digest = np.zeros((2, len(counts)), np.uint64)
        for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            if not count:
                continue
            own = slice(end - count, end)
            digest[0, i], digest[1, i] = flat[own].sum(), mixed[own].sum()
            short = count - -(-percent * count // 100) + 1
            f = frequent[own]
            for small in (True, False):
                if count > reach if small else count <= SMALL:
                    continue
                rank = f if small else np.where(f, 2, flat[own] >= LOW)
                take = np.argsort(rank, kind="stable")[:short]  # by rank, then by hash
                prefixes[small].append(flat[own][take])
                heavy[small][i] = f[take].sum()
                lengths[small][i] = short
        lists = [list_column(np.concatenate(prefixes[s]).view(np.int64) if prefixes[s] else np.zeros(0, np.int64), lengths[s], pa.int64()) for s in (True, False)]
        return _record(
            "doc_id n digest_1 digest_2 small small_often large large_often",
            batch.column("doc_id"), pa.array(counts.astype(np.int32)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
            lists[0], pa.array(heavy[True]), lists[1], pa.array(heavy[False]),
        )

    return _by_text(docs, run, PREFIXES)


def _need(percent: int, x, y, x_often, y_often):
    """How many of their frequency's short lists two documents must share at least; needs only integers."""
    total = -(-percent * (x + y) // (100 + percent))
    rest = np.maximum(-(-percent * x // 100), -(-percent * y // 100)) - 1
    return total - rest - np.minimum(x_often, y_often)


def _list_pairs(percent: int, long_list: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads sorted postings; a short list gives its pairs, a long one a chain and a star.

    ``frequent`` of a list's first posting: 1 a frequent shingle's list, 2 one
    that was found to be long and goes on from an earlier batch.
    """

    def pairs(n: np.ndarray, doc: np.ndarray, often: np.ndarray, i: np.ndarray, j: np.ndarray, star: int) -> pa.RecordBatch:
        fits = (np.maximum(n[i], n[j]) * percent <= np.minimum(n[i], n[j]) * 100) & (doc[i] != doc[j])
        i, j = i[fits], j[fits]
        none = [pa.nulls(len(i), kind) for kind in (pa.int64(), pa.int8(), pa.int32())]
        need = _need(percent, n[i], n[j], often[i], often[j])
        a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
        return _record("a b light need star shingle large n", pa.array(a), pa.array(b), pa.array(np.full(len(a), 1 - star, np.int32)), pa.array(need.astype(np.int32)), pa.array(np.full(len(a), star, np.int32)), *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        for batch in gathered(batches):
            columns = [np.asarray(c) for c in batch.columns]
            if carry is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(carry, columns, strict=True)]
            new = np.ones(len(columns[0]), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
            starts = np.flatnonzero(new)
            cut = int(starts[-1]) if len(starts) else 0
            yield from lists(columns, starts[:-1], cut)
            # the last list may go on: a short one waits whole, a long one by its head and last posting
            carry = [c[cut:].copy() for c in columns]
            if len(carry[0]) > 2 and (carry[3][0] or len(carry[0]) >= long_list):
                yield from lists(carry, np.zeros(1, np.int64), len(carry[0]))
                carry = [c[[0, -1]] for c in carry]
                carry[3][0] = 1 if carry[3][0] == 1 else 2
        if carry is not None and len(carry[0]):
            yield from lists(carry, np.zeros(1, np.int64), len(carry[0]))

    def lists(columns: list[np.ndarray], starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        if not len(starts):
            return
        frequent, n, doc, often = columns[3], columns[4].astype(np.int64), columns[5], columns[6]
        lengths = np.diff(np.append(starts, end))
        found = ((frequent[starts] == 0) & (lengths >= long_list)) | (frequent[starts] == 2)
        hot = frequent[starts].astype(bool) | found
        if found.any():
            done = np.where(frequent[starts[found]] == 2, 2, 0)  # the head and last posting of what was read before
            count = lengths[found] - done
            index = np.repeat(starts[found] + done, count) + _within(count)
            none = pa.nulls(len(index), pa.int64()), *(pa.nulls(len(index), pa.int32()) for _ in range(3))
            yield _record("a b light need star shingle large n", pa.array(doc[index]), *none, pa.array(columns[0][index]), pa.array(columns[1][index]), pa.array(n[index].astype(np.int32)))
        own, count = starts[hot], lengths[hot]
        own, count = own[count > 1], count[count > 1]
        if len(own):
            index = np.repeat(own, count - 1) + _within(count - 1) + 1
            yield pairs(n, doc, often, index - 1, index, 1)
            yield pairs(n, doc, often, np.repeat(own, count - 1), index, 1)
        own, count = starts[~hot], lengths[~hot]
        for m in np.unique(count[count > 1]).tolist():
            rows = own[count == m]
            x, y = np.triu_indices(m, 1)
            for at in range(0, len(rows), max(1, 200_000 // len(x))):
                base = rows[at : at + max(1, 200_000 // len(x)), None]
                yield pairs(n, doc, often, (base + x).ravel(), (base + y).ravel(), 0)

    return run


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count - 1 for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _sets(docs: DataFrame, n: int, shared: Broadcast) -> DataFrame:
    """SETS rows of the documents in the filter ``shared``; part: a digest that tells sets of one id apart."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = np.asarray(batch.column("doc_id").fill_null(0))
        keep = in_filter(ids, shared.value) & np.asarray(batch.column("doc_id").is_valid())
        if not keep.any():
            return None
        batch = batch.filter(pa.array(keep))
        flat, counts = shingle_sets(batch.column("text"), n)
        own = [flat[e - c : e] for e, c in zip(np.cumsum(counts), counts, strict=True)]
        part = pa.array(np.array([x.sum() for x in own], np.uint64).view(np.int64))
        return _record("doc_id part n shingles", batch.column("doc_id"), part, pa.array(counts.astype(np.int32)), pa.array([x.tobytes() for x in own], pa.binary()))

    return _by_text(docs, sets, SETS)


def _linked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the overlap, found by binary probes."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int(_is_in(x, y).sum()) if len(x) else 0
                keep.append(bool(len(x)) and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = whole.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = whole.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return durable(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(probe, "a long, b long").distinct())


def _links(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that link."""
    shared = docs.sparkSession.sparkContext.broadcast(member_filter(pairs.select("a").union(pairs.select("b")).distinct()))
    links = _linked(pairs, _sets(docs, n, shared), percent)
    shared.destroy()
    return links


def _total(percent: int, x, y):
    """The overlap T that sets of x and y shingles need, as a column."""
    return F.ceil(percent * (x + y) / (100 + percent) - 1e-9)


def _crossing(lists: DataFrame, key: list[str]) -> DataFrame:
    """The rows of lists that several labels share; main: the most frequent label, rest: the rows of all others."""
    labels = lists.groupBy(*key, "label").agg(F.count("*").alias("held"))
    labels = labels.groupBy(*key).agg(F.max(F.struct("held", "label")).alias("most"), F.sum("held").alias("held"))
    return durable(lists.join(labels.select(*key, F.col("most.label").alias("main"), (F.col("held") - F.col("most.held")).alias("rest")).where("rest > 0"), key))


def _met(lists: DataFrame, key: list[str], percent: int) -> DataFrame:
    """Pairs x, y of different labels and near sizes in a list, once each: those outside the main label meet all others."""
    x, y = lists.where("label <> main").alias("x"), lists.alias("y")
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    near = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    return x.join(y, reduce(and_, [*same, F.col("x.label") != F.col("y.label"), once, near]))


def _pair() -> list[Column]:
    return [F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")]


def _references(lists: DataFrame) -> DataFrame:
    """(path, head, doc_id, label, head_label): the members of each reference; lists: path, key, doc_id, label."""
    weight = lists.groupBy("path", "doc_id").agg(F.count("*").alias("lists"))
    heads = lists.join(weight, ["path", "doc_id"]).groupBy("path", "key").agg(F.max(F.struct("lists", F.bitwise_not("doc_id").alias("first"), "label")).alias("most"))
    heads = heads.select("path", "key", F.bitwise_not("most.first").alias("head"), F.col("most.label").alias("head_label"))
    return lists.join(heads, ["path", "key"]).groupBy("path", "head", "doc_id").agg(F.min("label").alias("label"), F.min("head_label").alias("head_label"))


def _differences(members: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """DIFFERENCES rows: the members' sets against their reference's; those that link with it get its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, size, both = [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                other = np.concatenate([x[~_is_in(x, y)], y[~_is_in(y, x)]])
                shared = (len(x) + len(y) - len(other)) // 2
                linked.append(100 * shared >= percent * (len(x) + len(y) - shared))
                size.append(len(other))
                both.append(other)
            flat = np.concatenate(both).view(np.int64) if both else np.zeros(0, np.int64)
            label = np.where(linked, np.asarray(batch.column("head_label")), np.asarray(batch.column("label")))
            yield _record(
                "path doc_id part label head linked n size differences",
                batch.column("path"), batch.column("doc_id"), batch.column("part"), pa.array(label), batch.column("head"), pa.array(linked, pa.bool_()), batch.column("n"),
                pa.array(size, pa.int32()), list_column(flat, np.array(size, np.int64), pa.int64()),
            )

    members = durable(members)
    heads = members.select(F.col("head").alias("doc_id")).distinct()
    one = whole.join(heads, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("part", "shingles")).alias("s")).select(F.col("doc_id").alias("head"), F.col("s.shingles").alias("y"))
    rows = members.join(whole, "doc_id").join(one, "head").select(F.xxhash64("path", "head").alias("path"), "doc_id", "part", "label", "head", "head_label", "n", F.col("shingles").alias("x"), "y")
    return durable(rows.mapInArrow(run, DIFFERENCES))


def _prefix_of_differences(apart: DataFrame, percent: int) -> DataFrame:
    """(path, key, doc_id, part, label, n, size, at): each set's rarest differences, as many as may all be another's than a partner's, and one; at: their place from 1."""
    flat = apart.select("path", "doc_id", "part", "label", "n", "size", F.explode("differences").alias("key"))
    flat = flat.withColumn("held", F.count("*").over(Window.partitionBy("path", "key")))
    place = F.row_number().over(Window.partitionBy("path", "doc_id", "part").orderBy("held", "key"))
    first = flat.withColumn("at", place).where(F.col("at") <= F.floor(F.col("n") * (100 - percent) / percent + 1e-9) + 1)
    return durable(first.where("held > 1").drop("held"))


def _cross_links(docs: DataFrame, hot: DataFrame, labels: DataFrame, tried: DataFrame, n: int, percent: int, long_list: int) -> DataFrame | None:
    """Links (a, b) between different components that share no short list, found by long ones; None if there are no candidates.

    hot: the postings (shingle, large, n, doc_id, often) of long lists; often: how many of them the document has.
    """
    hot = hot.join(labels, hot.doc_id == labels.vertex, "left").select("shingle", "large", "n", "doc_id", "often", F.coalesce("root", "doc_id").alias("label"))

    def need(x, y):
        return _total(percent, x, y) - F.ceil(F.greatest(x, y) * percent / 100 - 1e-9) + 1

    near = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.large") == F.col("y.large"))
    # per list and size: may any document of that size be a partner?
    sizes = hot.groupBy("shingle", "large", "n").agg(F.max("often").alias("often"), F.min("label").alias("low"), F.max("label").alias("high"))
    other = (F.col("y.low") != F.col("x.label")) | (F.col("y.high") != F.col("x.label"))
    able = hot.alias("x").join(sizes.alias("y"), same & near & other & (need(F.col("x.n"), F.col("y.n")) <= F.least("x.often", "y.often")), "left_semi")
    lists = _crossing(able, ["shingle", "large"])
    few, many = lists.where(F.col("rest") < long_list), lists.where(F.col("rest") >= long_list)
    met = _met(few, ["shingle", "large"], percent).select(*_pair(), need(F.col("x.n"), F.col("y.n")).alias("need"), F.least("x.often", "y.often").alias("often"))
    met = met.where("need <= often").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need"))
    in_many = many.groupBy("doc_id").agg(F.count("*").alias("more"))
    for side in ("a", "b"):
        met = met.join(in_many.select(F.col("doc_id").alias(side), F.col("more").alias(f"{side}_more")), side, "left")
    met = met.where(F.col("n") + F.coalesce(F.least(*(F.coalesce(f"{side}_more", F.lit(0)) for side in "ab")), F.lit(0)) >= F.col("need"))
    pairs = durable(met.select("a", "b").join(tried, ["a", "b"], "left_anti"))
    rest = durable(many.select(F.lit(0).cast("long").alias("path"), F.xxhash64("shingle", "large").alias("key"), "doc_id", "label").distinct())
    ids = durable(pairs.select("a").union(pairs.select("b")).union(rest.select("doc_id")).distinct())
    if not ids.limit(1).count():
        return None
    shared = docs.sparkSession.sparkContext.broadcast(member_filter(ids))
    whole = durable(_sets(docs, n, shared).where("n > 0").dropDuplicates(["doc_id", "part"]))
    shared.destroy()
    links = _linked(pairs, whole, percent)
    for left in range(ROUNDS - 1, -1, -1):
        if not rest.limit(1).count():
            break
        apart = _differences(_references(rest), whole, percent)
        lists = _crossing(_prefix_of_differences(apart, percent), ["path", "key"])
        few = lists.where(F.col("rest") < 4 * long_list) if left else lists
        # of what two sets share, the rarest leaves room for all that they must share
        must = F.ceil((F.col("x.size") + F.col("y.size") - F.col("x.n") - F.col("y.n")) / 2 + _total(percent, F.col("x.n"), F.col("y.n")))
        room = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) + 1
        links = links.union(_linked(_met(few, ["path", "key"], percent).where(room >= must).select(*_pair()).distinct(), whole, percent))
        links = links.union(apart.where("linked AND doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")))
        rest = durable(lists.where(F.col("rest") >= 4 * long_list).select("path", "key", "doc_id", "label").distinct() if left else rest.limit(0))
    return links


def _same_id(held: DataFrame, single: DataFrame) -> DataFrame:
    """Edges (a, b) between the first documents of sets that rows of one id hold."""
    several = held.groupBy("doc_id").agg(F.countDistinct("digest_1", "digest_2").alias("sets")).where("sets > 1").select("doc_id")
    firsts = held.join(several, "doc_id").select("doc_id", "digest_1", "digest_2").join(single.select("digest_1", "digest_2", F.col("doc_id").alias("b")), ["digest_1", "digest_2"])
    return firsts.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, often: int = 16, most_often: int = 1_000_000, long_list: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    docs = small_batches(docs.select("doc_id", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(_often(docs, n, percent, often, most_often))
    rows = durable(_prefixes(docs, n, percent, shared))
    held = rows.where("n > 0 AND doc_id IS NOT NULL")
    # one document of each set, the first
    single = held.groupBy("digest_1", "digest_2").agg(F.min(F.struct("doc_id", "n", "small", "small_often", "large", "large_often")).alias("r")).select("digest_1", "digest_2", "r.*")
    single = durable(single)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_often, parts = shared.value
        for batch in batches:
            for large, name in enumerate(("small", "large")):
                lists = batch.column(name)
                counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                shingles = np.asarray(lists.flatten())
                doc = np.repeat(np.asarray(batch.column("doc_id")), counts)
                frequent = _is_in(shingles.view(np.uint64), shingles_often)
                at = np.searchsorted(shingles_often, shingles.view(np.uint64)[frequent])
                size = np.log(np.maximum(np.asarray(batch.column("n")), 1)) / np.log(1.2)
                # a frequent shingle's list is split by size and, if it is very long, by a hash of posting and document
                part = np.zeros(len(shingles), np.int32)
                part[frequent] = np.repeat(size, counts)[frequent].astype(np.int32) + 256 * (splitmix((doc ^ shingles).view(np.uint64)[frequent]) % parts[at]).astype(np.int32)
                often = np.asarray(batch.column(f"{name}_often"))
                yield _record(
                    "shingle large part frequent n doc_id often light",
                    pa.array(shingles), pa.array(np.full(len(shingles), large, np.int8)), pa.array(part), pa.array(frequent.astype(np.int8)), pa.array(np.repeat(np.asarray(batch.column("n")), counts)),
                    pa.array(doc), pa.array(np.repeat(often, counts)), pa.array(np.repeat(counts.astype(np.int32) - often, counts)),
                )

    postings = single.mapInArrow(post, "shingle long, large byte, part int, frequent byte, n int, doc_id long, often int, light int")
    ordered = postings.repartition("shingle", "large", "part").sortWithinPartitions("shingle", "large", "part", "light", "n", "doc_id")
    met = ordered.drop("light").mapInArrow(_list_pairs(percent, long_list), MET)
    met = durable(met.groupBy("a", "b", "shingle", "large").agg(F.sum("light").alias("light"), F.min("need").alias("need"), F.max("star").alias("star"), F.max("n").alias("n")))
    found = met.where("shingle IS NOT NULL").select("shingle", "large", "n", F.col("a").alias("doc_id"))
    hot = postings.where("frequent = 1").select("shingle", "large", "n", "doc_id", "often")
    pairs = met.where("shingle IS NULL")
    if found.limit(1).count():  # lists that turned out long: what a pair needs of short ones is less by those both may have
        in_long = durable(found.groupBy("doc_id").agg(F.count("*").cast("int").alias("more")))
        hot = hot.union(found.withColumn("often", F.lit(0))).groupBy("doc_id", "shingle", "large", "n").agg(F.max("often").alias("often"))
        known = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.greatest("small_often", "large_often")).alias("before"))
        hot = hot.join(in_long, "doc_id", "left").join(known, "doc_id").select("shingle", "large", "n", "doc_id", (F.greatest("often", "before") + F.coalesce("more", F.lit(0))).alias("often"))
        pairs = pairs.join(in_long.select(F.col("doc_id").alias("a"), F.col("more").alias("x")), "a", "left").join(in_long.select(F.col("doc_id").alias("b"), F.col("more").alias("y")), "b", "left")
        pairs = pairs.withColumn("need", F.col("need") - F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))))
    tried = durable(pairs.where("star = 1 OR light >= need").select("a", "b"))
    links = _links(docs, tried, n, percent).union(_same_id(held, single))
    labels = components(links)
    later = _cross_links(docs, hot, labels, tried, n, percent, long_list)
    shared.destroy()
    if later is not None and later.limit(1).count():  # the components found so far stand for their links
        labels = components(labels.select(F.col("vertex").alias("a"), F.col("root").alias("b")).union(later))
    # every copy follows the document of its set; rows that share an id share a component
    roots = single.join(labels, single.doc_id == labels.vertex, "left").select("digest_1", "digest_2", F.coalesce("root", "doc_id").alias("component_id"))
    members = rows.join(roots, ["digest_1", "digest_2"], "left")
    alone = F.when(F.col("n") > 0, F.col("component_id"))
    return members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(alone, "doc_id")).alias("component_id"))
