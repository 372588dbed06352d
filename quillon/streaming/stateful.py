"""Streams with state of their own: running balances, breaks of their chain, and refund claims.

Rows may come late and in any order. They wait in the state of their key until
the watermark has passed their day, then the key's rows of that day are taken
in the ledger's order. So what a stream gives does not depend on how its rows
fell into micro-batches: it is what the batch operators give for the days that
the watermark has closed; rows later than the watermark are dropped by Spark.

One timer a key is set for the next thing to do: the end of the earliest waiting
day, or the day an open purchase is too old to be given back. Waiting rows are
those of the watermark's delay, open purchases those of ``refunds.DAYS`` days
before the watermark. Both are kept as pieces of many rows each, as a call of
the state store takes far longer than a row: a piece is added for each arrival,
and all are read and what is left is written when a day of the key closes. So
what a key has seen long ago costs nothing. Amounts are cents inside.

Rows with a null in the key, the time, the id or the amount take no part; rows
of one (day, seq, id) are one row, the last that came.
"""

from __future__ import annotations

import datetime as dt
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.functions.expressions import credit, debit, refund
from quillon.operators.refunds import DAYS, _Open

_STORE = "spark.sql.streaming.stateStore.providerClass"
_DAY = 86_400_000
_FIRST = dt.date(1970, 1, 1)
#: Rows of a piece in the state.
_PIECE = 10_000


def _pieces(rows: list[tuple]) -> Iterator[tuple[bytes]]:
    for at in range(0, len(rows), _PIECE):
        yield (zlib.compress(pickle.dumps(rows[at : at + _PIECE]), 1),)


def _in_pieces(state: object) -> Iterator[tuple]:
    for (piece,) in state.get():
        yield from pickle.loads(zlib.decompress(piece))


class _ByDay(StatefulProcessor):
    """Rows wait until their day is closed, then ``take`` gets them in order of (day, rank, seq, id)."""

    #: What tells a waiting row apart, and what else it holds.
    place = ("day", "rank", "seq", "id")
    values: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            plain = [[None if v != v or v is None else v if isinstance(v, str) else int(v) for v in frame[name].tolist()] for name in (*self.place, *self.values)]
            for piece in _pieces(list(zip(*plain, strict=True))):
                self.waiting.appendValue(piece)
            first = int(frame["day"].min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(_closes(earliest))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        n = len(self.place)
        rows = {row[:n]: row[n:] for row in _in_pieces(self.waiting)} if self.waiting.exists() else {}
        due = sorted((place, rest) for place, rest in rows.items() if _closes(place[0]) <= now)
        later = [place + rest for place, rest in rows.items() if _closes(place[0]) > now]
        if due:
            self.waiting.clear()
            for piece in _pieces(later):
                self.waiting.appendValue(piece)
        out = self.take(key, due, now)
        if later:
            self._wake(min(_closes(row[0]) for row in later))
        if len(out):
            yield out

    def _wake(self, at: int) -> None:
        """Sets the timer for ``at`` unless an earlier one is set."""
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def take(self, key: tuple, due: list[tuple], now: int) -> pd.DataFrame:
        raise TypeError("a kind of rows says what it does with them")


def _closes(day: int) -> int:
    """When the watermark has passed a day, given as days since 1970, in milliseconds."""
    return (day + 1) * _DAY - 1


class _Balance(_ByDay):
    values = ("flow", "printed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.so_far = handle.getValueState("so_far", "balance long, printed long")

    def take(self, key: tuple, due: list[tuple], now: int) -> pd.DataFrame:
        balance, before = self.so_far.get() if self.so_far.exists() else (0, None)
        out = []
        for (day, _, _, id_), (flow, printed) in due:
            balance += flow
            # a tolerance of 1.1 cents
            broken = None if printed is None else before is not None and abs(before + flow - printed) > 1
            before = before if printed is None else printed
            out.append((key[0], id_, day, balance, broken))
        self.so_far.update((balance, before))
        return pd.DataFrame(out, columns=["user_id", "id", "day", "balance", "broken"]).astype({"broken": "object"})


class _Claims(_ByDay):
    """Claims of a user's merchants, each by itself; they share a state, as most have few rows a day."""

    place = ("day", "rank", "seq", "id", "key")
    values = ("amount",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "rows binary")

    def take(self, key: tuple, due: list[tuple], now: int) -> pd.DataFrame:
        # a refund that is still to come is of the first day that is not closed, or later
        first = (now + 1) // _DAY - DAYS
        was_open = list(_in_pieces(self.open)) if self.open.exists() else []
        merchants: dict[str, list[tuple]] = defaultdict(list)
        for day, seq, id_, merchant, amount in was_open:
            merchants[merchant].append((day, 0, seq, id_, amount))
        for (day, rank, seq, id_, merchant), (amount,) in due:
            merchants[merchant].append((day, rank, seq, id_, amount))
        left, out = [], []
        for merchant, rows in merchants.items():
            held, unclaimed = _Open(), {}
            # debits rise in preference, refunds come after a day's debits, in turn
            for day, rank, seq, id_, amount in sorted(rows, key=lambda x: (x[0], x[1], x[2], _falling(x[3]) if x[1] == 0 else [], x[3])):
                date = _FIRST + dt.timedelta(day)
                oldest = date - dt.timedelta(DAYS)
                if rank == 0:
                    held.add((date, amount, id_), oldest)
                    unclaimed[id_] = (day, seq, id_, merchant, amount)
                elif (found := held.claim(amount, oldest)) is not None:
                    out.append((key[0], id_, found))
                    unclaimed.pop(found, None)
            left += [row for row in unclaimed.values() if row[0] >= first]
        if left != was_open:
            self.open.clear()
            for piece in _pieces(left):
                self.open.appendValue(piece)
        if left:
            self._wake(_closes(min(row[0] for row in left) + DAYS + 1))
        return pd.DataFrame(out, columns=["user_id", "refund_id", "debit_id"])


def _falling(text: str) -> list[int]:
    """A key that sorts texts in descending order of their code points."""
    return [-ord(c) for c in text] + [1]


def _rows(stream: DataFrame, time: str, late: str, *values: object) -> DataFrame:
    day = F.datediff(F.to_date(time), F.lit("1970-01-01")).cast("long").alias("day")
    whole = F.col("user_id").isNotNull() & F.col(time).isNotNull() & F.col("id").isNotNull() & F.col("amount").isNotNull()
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq")
    stream.sparkSession.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withWatermark(time, late).where(whole).select("user_id", time, day, seq, "id", *values)


def _cents(column: str) -> object:
    return F.round(F.col(column).cast("decimal(20,4)") * 100).cast("long")


def running_balance(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """user_id, id, day, balance, broken: each row's running sum in cents, and whether its printed ``balance_after`` breaks the chain.

    broken: null without a printed balance, false for the first one.
    """
    printed = _cents("balance_after") if "balance_after" in stream.columns else F.lit(None).cast("long")
    flow = F.when(credit(), _cents("amount")).otherwise(-_cents("amount"))
    rows = _rows(stream, time, late, F.lit(0).alias("rank"), flow.alias("flow"), printed.alias("printed"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Balance(), "user_id long, id string, day long, balance long, broken boolean", "append", "eventTime")


def refund_links(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """user_id, refund_id, debit_id: the exclusive links of ``refunds.greedy_links``, as the days close."""
    back = F.when(refund(), 1).when(debit(), 0)
    rows = _rows(stream.where(back.isNotNull() & F.col("merchant").isNotNull()), time, late, F.lower("merchant").alias("key"), back.alias("rank"), _cents("amount").alias("amount"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Claims(), "user_id long, refund_id string, debit_id string", "append", "eventTime")
