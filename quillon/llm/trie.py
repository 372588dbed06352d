"""The prefix trie of conversations, from the Cartesian tree over their sorted order.

A conversation is its sequence of turns, a turn its (role, text). A node of
depth d is a different sequence of first d turns; its members are the
conversations that start with it, the root's all.

Work on Spark: a turn is a 128-bit hash and its number of words; a conversation
is one row of these (some 24 bytes a turn). The rows are sorted by (sequence,
id) over ranges, so that equal conversations, however many, spread over as many
ranges as they need; one range is one block of about ``block`` turns. Over the
array of LCPs (turns shared with the conversation before), every block finds
the nearest smaller values of its own elements with a stack: an element with
the value v and its nearest smaller neighbours bound the interval of a
Cartesian tree node of depth v; equal values in one interval are one node, and
the depths between a node and its parent are nodes of the same interval.

What a block cannot close alone lies on the path of its last conversation: a
row for each depth shared with the next block, at most. Each looks for the next
block whose minimum is smaller, adds up the blocks in between from a table of
one row a block, and takes the rest from the prefix minima that the block found
has left; parents that began before a block are found the same way backwards.
Sums over an interval are differences of running sums.

Defined results: turns are in order of turn, null first, equal ones in order of
the hash of (role, text); a null role or text is empty. Rows without conv_id
take no part. Repeated rows are turns of their own. A conversation that comes
out without turns is a member of the root. An empty table gives no node.
Columns other than conv_id, turn, role and text are not read. The list of ids
behind ``ends_sha256`` is hashed in order, so that of one node passes through
one task, as a stream of a string for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillon.session import durable

WORD = r"[^\x20\x09-\x0D]+"
WIDTH = 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Kinds of rows that a block leaves.
NODE, OPEN, CLOSING, BLOCK, PIECE = range(5)
#: Where the parent of a row is: among the open rows of the same block, or of an earlier one.
HERE, EARLIER = range(2)
_LEFT = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("depth", pa.int32()), ("conv", pa.int64()), ("parent", pa.int64()), ("side", pa.int32()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("before", pa.int64()), ("ends", pa.string())])
LEFT = "kind int, block int, depth int, conv long, parent long, side int, n long, kids long, leaves long, saved long, before long, ends string"


def rebuilt(conversations: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """conv_id, key, words: the first ``taken`` turns of conversation ``base``, then the own turns behind as many.

    key holds the turns' hashes one after the other, words their words; most: the largest value of ``taken``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", turn.alias("turn_key"), words.alias("words")).alias("t"))
    own = durable(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    both = own.select("conv_id", "turns", base.alias("base"), taken.cast("int").alias("h")).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    first = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    whole = both.select("conv_id", F.concat(first, rest).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["turn_key"]), ""))
    return whole.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their start."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    same = np.frombuffer(a, np.uint8, n * WIDTH) == np.frombuffer(b, np.uint8, n * WIDTH)
    return int(np.argmin(same)) // WIDTH


def _edges(blocks: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Per block that has rows: (LCP with the block before, that block's last length, LCP with the block behind)."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("key")
                found = (batch.column("block")[0].as_py(), found[1] if found else keys[0].as_py(), keys[-1].as_py())
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "first", "last"), found, strict=True))], schema=pa.schema([("block", pa.int32()), ("first", pa.binary()), ("last", pa.binary())]))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["block"], -1, -1) if r["was"] is None else (r["block"], lcp(r["was"], r["first"]), len(r["was"]) // WIDTH) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], names=["block", "shared", "length"])

    bounds = blocks.select("block", "key").mapInArrow(ends, "block int, first binary, last binary")
    # one row for each block here
    bounds = bounds.withColumn("was", F.lag("last").over(Window.orderBy("block"))).select("block", "first", "was")
    rows = sorted(tuple(r) for r in bounds.mapInArrow(shared, "block int, shared int, length int").collect())
    return {b: (s, n, rows[i + 1][1] if i + 1 < len(rows) else -1) for i, (b, s, n) in enumerate(rows)}


class _Entry:
    """An open node of the current path: its depth, its first conversation's running sums, what is below so far."""

    __slots__ = ("depth", "start", "least", "kids", "waiting", "ends")

    def __init__(self, depth: int, start: tuple | None, least: int | None, kids: int = 0, ends: str | None = NOTHING):
        self.depth, self.start, self.least, self.kids, self.ends = depth, start, least, kids, ends
        self.waiting: list[int] = []

    def meet(self, least: int | None) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least


class _Walk:
    """Nearest smaller values of one block. The entry at the bottom began before the block (start is None)."""

    def __init__(self, block: int, shared: int):
        self.block, self.rows = block, []
        self.stack = [_Entry(shared, None, None)]
        self.n = self.own = self.fresh = self.childless = 0
        self.least: int | None = None
        self.length, self.words, self.last_start = None, [0], 0

    def row(self, kind: int, depth: int, **values: object) -> int:
        self.rows.append({"kind": kind, "block": self.block, "depth": depth} | values)
        return len(self.rows) - 1

    def before(self, depth: int) -> int:
        """Words of the path's turns before the last of ``depth``."""
        return self.words[depth - 1] if depth > 0 else 0

    def part(self, entry: _Entry, depth: int) -> dict:
        n0, own0, childless0, fresh, words = entry.start
        left = (self.own - own0) - (self.fresh - fresh) - (words - self.before(depth))
        return {"conv": entry.least, "n": self.n - n0, "leaves": self.childless - childless0, "saved": left, "kids": entry.kids if depth == entry.depth else 1}

    def close(self, entry: _Entry, above: int) -> int:
        """The nodes of an interval, for all depths below ``above``; the row of the topmost."""
        first = len(self.rows)
        for depth in range(above + 1, entry.depth + 1):
            values = self.part(entry, depth)
            values["saved"] -= values["n"] * self.before(depth)
            self.row(NODE, depth, parent=entry.least if depth > above + 1 else None, ends=entry.ends if depth == entry.depth else NOTHING, **values)
        for child in entry.waiting:
            self.rows[child]["parent"] = entry.least
        return first

    def elsewhere(self, entry: _Entry) -> None:
        """The parent of the waiting rows is an open row, of this block or of an earlier one."""
        for child in entry.waiting:
            if self.rows[child]["depth"]:
                self.rows[child]["side"] = HERE if entry.start else EARLIER

    def fall(self, shared: int, bottom: bool) -> None:
        """Closes what is deeper than ``shared``; bottom: also what began before the block."""
        stack, child = self.stack, None
        while stack[-1].depth > shared and (bottom or len(stack) > 1):
            entry = stack.pop()
            if entry.start is None:
                for depth in range(shared + 1, entry.depth + 1):
                    self.row(CLOSING, depth, conv=entry.least, n=self.n, saved=self.own - self.fresh, leaves=self.childless, kids=entry.kids if depth == entry.depth else 0)
                self.elsewhere(entry)
                stack.append(_Entry(shared, None, entry.least))
                break
            above = max(shared, stack[-1].depth)
            top = self.close(entry, above)
            if above == stack[-1].depth:
                stack[-1].meet(entry.least)
                stack[-1].waiting.append(top)
            else:
                child = (top, entry)
        if stack[-1].depth < shared:
            top, entry = child
            stack.append(_Entry(shared, entry.start, entry.least, kids=1))
            stack[-1].waiting.append(top)

    def leaf(self, shared: int, words: list[int], n: int, least: int, ids: str) -> None:
        """The next different conversation: turns shared with the one before, words, members."""
        if self.length is not None:
            self.childless += shared < self.length
            self.fall(shared, bottom=True)
        self.length, self.words, self.last_start = len(words), [0, *accumulate(words)], self.n
        total = self.words[-1]
        fresh = total - (self.words[shared] if shared > 0 else 0)
        if self.length > shared:
            self.stack[-1].kids += 1
            self.stack.append(_Entry(self.length, (self.n, self.own, self.childless, self.fresh + fresh, total), least, ends=hashlib.sha256(ids.encode()).hexdigest()))
        else:
            self.stack[-1].meet(least)
        self.n, self.own, self.fresh = self.n + n, self.own + n * total, self.fresh + fresh
        self.least = least if self.least is None else min(self.least, least)

    def end(self, shared: int, last_began: bool) -> None:
        """The block behind shares so many turns; last_began: the last conversation has no copy in an earlier block."""
        self.childless += shared < self.length
        self.fall(shared, bottom=False)
        bottom = self.stack[0]
        for entry, under in zip(self.stack[:0:-1], self.stack[-2::-1], strict=True):
            for depth in range(under.depth + 1, entry.depth + 1):
                goes_on = last_began and depth == self.length and entry.start[0] == self.last_start
                side = None if not depth else HERE if depth - 1 > bottom.depth else EARLIER
                self.row(OPEN, depth, side=side, before=self.before(depth), ends=None if goes_on else entry.ends if depth == entry.depth else NOTHING, **self.part(entry, depth))
            self.elsewhere(entry)
            under.meet(entry.least)
        self.elsewhere(bottom)
        self.row(BLOCK, bottom.depth, conv=self.least, n=self.n, saved=self.own - self.fresh, leaves=self.childless, kids=bottom.kids)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """(key, words, ids) of each different conversation of a block, in order."""
    key = words = None
    ids: list[int] = []
    for batch in batches:
        for k, w, i in zip(batch.column("key").to_pylist(), batch.column("words").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key:
                if ids:
                    yield key, words, ids
                key, words, ids = k, w, []
            ids.append(i)
    if ids:
        yield key, words, ids


def _walked(blocks: DataFrame, edges: dict[int, tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        block = first.column("block")[0].as_py()
        shared, was_length, behind = edges[block]
        walk, last = _Walk(block, shared), None
        pieces = []

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        began = True
        for key, words, ids in _runs(all_batches()):
            common = shared if last is None else lcp(last, key)
            began = last is not None or not (common == len(words) == was_length)
            text = ",".join(map(str, ids))
            if not began:
                pieces.append((EARLIER, len(words), text))
            walk.leaf(common, words, len(ids), ids[0], text)
            last = key
        if began and behind == walk.length:
            pieces.append((HERE, walk.length, text))
        walk.end(behind, began and behind == walk.length)
        for side, depth, text in pieces:
            walk.row(PIECE, depth, side=side, ends=text)
        for at in range(0, len(walk.rows), 20_000):
            yield pa.RecordBatch.from_pylist(walk.rows[at : at + 20_000], schema=_LEFT)

    return blocks.mapInArrow(run, LEFT)


class Blocks:
    """The table of blocks: nearest smaller minima, and sums over stretches of blocks."""

    def __init__(self, rows: list):
        self.number = np.array([r.block for r in rows], np.int64)
        self.place = {int(b): i for i, b in enumerate(self.number)}
        self.least = np.array([r.depth for r in rows], np.int64)
        self.kids = np.array([r.kids for r in rows], np.int64)
        self.conv = np.array([r.conv for r in rows], np.int64)
        self.total = {c: np.concatenate([[0], np.cumsum([getattr(r, c) for r in rows])]) for c in ("n", "saved", "leaves")}
        self.step = int(len(rows) ** 0.5) + 1
        self.group = np.array([self.least[i : i + self.step].min() for i in range(0, len(rows), self.step)], np.int64)

    def _first(self, order: range, depth: int) -> int | None:
        return next((i for i in order if self.least[i] < depth), None)

    def behind(self, at: int, depth: int) -> int:
        """The next block with a minimum under ``depth``; their number if there is none."""
        edge = min((at // self.step + 1) * self.step, len(self.least))
        if (found := self._first(range(at + 1, edge), depth)) is not None:
            return found
        group = next((g for g in range(at // self.step + 1, len(self.group)) if self.group[g] < depth), None)
        return len(self.least) if group is None else self._first(range(group * self.step, min((group + 1) * self.step, len(self.least))), depth)

    def ahead(self, block: int, depth: int) -> int:
        """The number of the last block before ``block`` with a minimum under ``depth``; there is one for every path."""
        at = self.place[block]
        if (found := self._first(range(at - 1, at // self.step * self.step - 1, -1), depth)) is None:
            group = next(g for g in range(at // self.step - 1, -1, -1) if self.group[g] < depth)
            found = self._first(range((group + 1) * self.step - 1, group * self.step - 1, -1), depth)
        return int(self.number[found])


def _with(df: DataFrame, name: str) -> StructType:
    return StructType([*df.schema.fields, StructField(name, IntegerType())])


def _owner(left: DataFrame, blocks: Blocks, depth: str) -> DataFrame:
    """``left`` with the block whose open row of that depth is meant in ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            out = []
            for b, d, s in zip(batch.column("block").to_pylist(), batch.column(depth).to_pylist(), batch.column("side").to_pylist(), strict=True):
                if s == EARLIER and (b, d) not in seen:
                    seen[b, d] = blocks.ahead(b, d)
                out.append(b if s == HERE else seen[b, d])
            yield batch.append_column("at", pa.array(out, pa.int32()))

    return left.mapInArrow(run, _with(left, "at"))


def _between(opened: DataFrame, blocks: Blocks) -> DataFrame:
    """Open rows with the whole blocks behind added, and the block that closes them in ``closing``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                at = blocks.place[r["block"]] + 1
                end = blocks.behind(at - 1, r["depth"])
                r["closing"] = int(blocks.number[end]) if end < len(blocks.number) else -1
                if end > at:
                    for c, total in blocks.total.items():
                        r[c] += int(total[end] - total[at])
                    r["conv"] = min(r["conv"], int(blocks.conv[at:end].min()))
                    r["kids"] += int(blocks.kids[at:end][blocks.least[at:end] == r["depth"]].sum())
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("closing", pa.int32())))

    return opened.mapInArrow(run, _with(opened, "closing"))


def _hashed(pieces: DataFrame) -> DataFrame:
    """(at, depth, ends): the hash of the ids of a conversation that lies in several blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for at, depth, text in zip(batch.column("at").to_pylist(), batch.column("depth").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if now == (at, depth):
                    digest.update(b",")
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (at, depth), hashlib.sha256()
                digest.update(text.encode())
        if now:
            out.append((*now, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=["at", "depth", "hashed"])

    return pieces.repartition("at", "depth").sortWithinPartitions("at", "depth", "block").select("at", "depth", "ends").mapInArrow(run, "at int, depth int, hashed string")


def trie(conversations: DataFrame, base: Column | None = None, taken: Column | None = None, most: int = 3, block: int = 200_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    base, taken, most: see ``rebuilt``; as given by default, conversations come as they are.
    """
    base = F.col("conv_id") if base is None else base
    whole = durable(rebuilt(conversations, base, F.lit(0) if taken is None else taken, most))
    turns = whole.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0))).first()[0]
    parts = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + turns // block)
    ordered = whole.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ordered = durable(ordered.withColumn("block", F.spark_partition_id()))
    left = durable(_walked(ordered, _edges(ordered)))
    blocks = Blocks(sorted(left.where(F.col("kind") == BLOCK).select("block", "depth", "conv", "n", "kids", "leaves", "saved").collect(), key=lambda r: r.block))
    hashed = _hashed(_owner(left.where(F.col("kind") == PIECE).select("block", "depth", "side", "ends"), blocks, "depth"))
    opened = left.where(F.col("kind") == OPEN).select("block", "depth", "conv", "side", "n", "kids", "leaves", "saved", "before", "ends")
    closing = left.where(F.col("kind") == CLOSING).select(F.col("block").alias("closing"), "depth", *[F.col(c).alias(f"{c}_there") for c in ("conv", "n", "kids", "leaves", "saved")])
    met = _between(opened, blocks).join(closing, ["closing", "depth"], "left").join(hashed.withColumnRenamed("at", "block"), ["block", "depth"], "left")
    there = {c: F.coalesce(F.col(f"{c}_there"), F.lit(0)) for c in ("n", "kids", "leaves", "saved")}
    n = F.col("n") + there["n"]
    crossing = durable(
        met.select(
            "block",
            "depth",
            "side",
            F.least("conv", "conv_there").alias("conv"),
            n.alias("n"),
            (F.col("kids") + there["kids"]).alias("kids"),
            (F.col("leaves") + there["leaves"]).alias("leaves"),
            (F.col("saved") + there["saved"] - n * F.col("before")).alias("saved"),
            F.coalesce("hashed", "ends").alias("ends"),
        )
    )
    values = ["conv", "depth", "parent", "n", "kids", "leaves", "saved", "ends"]
    inner = left.where(F.col("kind") == NODE)
    asks = inner.where("side IS NOT NULL").drop("parent").unionByName(crossing.where("side IS NOT NULL"), allowMissingColumns=True)
    asks = _owner(asks.select("block", "side", "conv", "depth", (F.col("depth") - 1).alias("above"), "n", "kids", "leaves", "saved", "ends"), blocks, "above")
    parents = crossing.select(F.col("block").alias("at"), F.col("depth").alias("above"), F.col("conv").alias("parent"))
    roots = crossing.where("side IS NULL").withColumn("parent", F.lit(None).cast("long"))
    nodes = inner.where("side IS NULL").select(values).unionByName(asks.join(parents, ["at", "above"]).select(values)).unionByName(roots.select(values))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
