"""Refund links and refund-netted spending.

Three rules net spending differently on purpose: summaries take all refunds
of a slice, netted rows only linked ones, period totals also the unlinked ones.
``links_scope`` says which rows may hold the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.expressions import credit, debit, refund, spending
from quillon.session import durable

DAYS = 90
#: Links that are still broadcast to the ledger, about 100 bytes each and twice.
BROADCAST_LINKS = 200_000
#: The same for what is given back alone, about 110 bytes a debit.
BROADCAST_OFFSETS = 1_000_000
#: Keys with refunds whose hashes are still broadcast, about 40 bytes each.
BROADCAST_KEYS = 2_000_000


def candidates(ledger: DataFrame) -> DataFrame:
    """(refund, debit) pairs: one user and merchant, the debit at most 90 days before and no smaller.

    An equi-join on user, merchant and a 90-day bucket (a debit also visits the
    next bucket), so the date range never becomes a nested loop.
    """
    day = F.datediff("date", F.lit("1970-01-01"))
    key = F.lower("merchant")
    refunds = ledger.where(refund()).select("user_id", key.alias("key"), F.floor(day / DAYS).alias("part"), F.col("id").alias("refund_id"), F.col("date").alias("refund_date"), F.col("seq").alias("refund_seq"), F.col("amount").alias("refund"))
    debits = ledger.where(debit()).select("user_id", key.alias("key"), F.explode(F.array(F.floor(day / DAYS), F.floor(day / DAYS) + 1)).alias("part"), F.col("id").alias("debit_id"), F.col("date").alias("debit_date"), F.col("seq").alias("debit_seq"), F.col("amount").alias("debit"))
    near = F.col("debit_date").between(F.date_sub("refund_date", DAYS), F.col("refund_date")) & (F.col("debit") >= F.col("refund"))
    return refunds.join(debits, ["user_id", "key", "part"]).where(near)


def best_links(ledger: DataFrame) -> DataFrame:
    """(user_id, refund_id, debit_id): each refund's best debit: exact amount first, then the latest; a debit may serve twice."""
    order = Window.partitionBy("user_id", "refund_id").orderBy(F.desc(F.col("debit") == F.col("refund")), F.desc("debit_date"), F.desc("debit_seq"), "debit_id")
    return candidates(ledger).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("user_id", "refund_id", "debit_id")


class _Open:
    """The unclaimed debits of one user and merchant, in order of preference; what is too old is dropped as it grows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []  # (date, amount, id), the most preferred last
        self.same: dict = {}  # amount -> places in rows, the most preferred last
        self.size = 64
        self.most: list = [None] * 128  # a tree over the places: the largest unclaimed amount

    def _set(self, place: int, amount) -> None:
        k = self.size + place
        self.most[k] = amount
        while k > 1:
            k //= 2
            x, y = self.most[2 * k], self.most[2 * k + 1]
            self.most[k] = x if y is None or (x is not None and x >= y) else y

    def add(self, row: tuple, oldest) -> None:
        if len(self.rows) == self.size:
            live = [r for place, r in enumerate(self.rows) if self.most[self.size + place] is not None and r[0] >= oldest]
            self.rows, self.same, self.size = [], {}, max(64, 2 * len(live))
            self.size = 1 << (self.size - 1).bit_length()
            self.most = [None] * (2 * self.size)
            for r in live:
                self._put(r)
        self._put(row)

    def _put(self, row: tuple) -> None:
        self.same.setdefault(row[1], []).append(len(self.rows))
        self.rows.append(row)
        self._set(len(self.rows) - 1, row[1])

    def claim(self, amount, oldest):
        """The id of the latest debit of this amount, else of the latest larger one, that is not older than ``oldest``."""
        places = self.same.get(amount, [])
        while places and self.most[self.size + places[-1]] is None:
            places.pop()
        place = places[-1] if places and self.rows[places[-1]][0] >= oldest else None
        if place is None and self.most[1] is not None and self.most[1] >= amount:
            k = 1
            while k < self.size:
                k = 2 * k + 1 if self.most[2 * k + 1] is not None and self.most[2 * k + 1] >= amount else 2 * k
            place = k - self.size
        if place is None or self.rows[place][0] < oldest:
            return None
        self._set(place, None)
        return self.rows[place][2]


def greedy_links(ledger: DataFrame) -> DataFrame:
    """As best_links, but in order of the refunds and each debit claimed once."""
    return _claims(ledger).drop("given")


def _claims(ledger: DataFrame, few: bool = False) -> DataFrame:
    """(user_id, refund_id, debit_id, given): exclusive links with the refund's amount.

    Each claim depends on those before it, so the rows of a (user, merchant)
    are read in order of time by one task: Spark sorts them on disk, no pairs
    are made, and the task holds the key's unclaimed debits of about 90 days.
    A row takes time in proportion to the logarithm of these. The ledger is
    read once; with ``few`` it is read for the keys that have refunds first, and
    rows of others, which nothing can claim, are not moved at all.
    """
    later = F.col("back") == 1
    back = F.when(refund(), 1).when(debit(), 0).alias("back")
    whole = F.col("user_id").isNotNull() & F.col("merchant").isNotNull() & F.col("date").isNotNull() & F.col("amount").isNotNull()
    rows = ledger.where(whole & (refund() | debit())).select("user_id", F.lower("merchant").alias("key"), "date", "seq", "id", "amount", back)
    if few:
        hashed = F.xxhash64("user_id", "key")
        keys = durable(rows.where(later).select(hashed.alias("_key")).distinct())
        if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            # keys of equal hash may stay too
            rows = rows.withColumn("_key", hashed).join(F.broadcast(keys), "_key", "left_semi").drop("_key")
    # a day's debits stand before its refunds; debits rise in preference, refunds go in turn
    order = ["user_id", "key", "date", "back", F.when(~later, F.col("seq")).asc_nulls_first(), F.when(~later, F.col("id")).desc(), F.when(later, F.col("seq")).asc_nulls_last(), F.when(later, F.col("id"))]
    rows = rows.repartition("user_id", "key").sortWithinPartitions(*order)

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, _Open()
        for batch in batches:
            out = []
            for user, key, date, id_, amount, is_back in zip(*(batch.column(c).to_pylist() for c in ("user_id", "key", "date", "id", "amount", "back")), strict=True):
                if at != (user, key):
                    at, held = (user, key), _Open()
                oldest = date - timedelta(days=DAYS)
                if not is_back:
                    held.add((date, amount, id_), oldest)
                elif (found := held.claim(amount, oldest)) is not None:
                    out.append((user, id_, found, amount))
            users, refunds, debits, given = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(refunds, pa.string()), pa.array(debits, pa.string()), pa.array(given, pa.decimal128(18, 2))], names=["user_id", "refund_id", "debit_id", "given"])

    return rows.mapInArrow(claim, "user_id long, refund_id string, debit_id string, given decimal(18,2)")


def with_links(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """The ledger with ``refund_for``, the debit a credit reverses."""
    named = links.select(F.col("user_id").alias("l_user"), "refund_id", F.col("debit_id").alias("refund_for"))
    return ledger.join(named, (F.col("user_id") == F.col("l_user")) & (F.col("id") == F.col("refund_id")), "left").drop("l_user", "refund_id")


def offsets(rows: DataFrame) -> DataFrame:
    """(user_id, id, refunded): what credits of these rows give back to a purchase among them."""
    back = rows.where(credit() & F.col("refund_for").isNotNull()).groupBy("user_id", F.col("refund_for").alias("id")).agg(F.sum("amount").alias("refunded"))
    return back.join(rows.where(debit()).select("user_id", "id"), ["user_id", "id"], "left_semi")


def linked(ledger: DataFrame) -> DataFrame:
    """The ledger with ``refund_for`` of a linked credit and ``refunded`` of its debit, by exclusive links over the whole history.

    The links are made once and kept in a checkpoint; both columns come from
    one join on the row's id, by broadcast while the links are few (a checked
    count), else by a shuffle.
    """
    links = durable(_claims(ledger))
    none = F.lit(None)
    marks = links.select(F.col("user_id").alias("m_user"), F.col("refund_id").alias("m_id"), F.col("debit_id").alias("refund_for"), none.cast("decimal(18,2)").alias("refunded"))
    marks = marks.union(links.select("user_id", "debit_id", none.cast("string"), "given"))
    if links.limit(BROADCAST_LINKS + 1).count() <= BROADCAST_LINKS:
        marks = F.broadcast(marks)
    return ledger.join(marks, (F.col("user_id") == F.col("m_user")) & (F.col("id") == F.col("m_id")), "left").drop("m_user", "m_id")


def given_back(ledger: DataFrame) -> DataFrame:
    """The ledger with ``refunded`` alone of what linked() adds, for ledgers few of whose rows are refunds."""
    links = durable(_claims(ledger, few=True))
    back = links.select(F.col("user_id").alias("m_user"), F.col("debit_id").alias("m_id"), F.col("given").alias("refunded"))
    if links.limit(BROADCAST_OFFSETS + 1).count() <= BROADCAST_OFFSETS:
        back = F.broadcast(back)
    return ledger.join(back, (F.col("user_id") == F.col("m_user")) & (F.col("id") == F.col("m_id")), "left").drop("m_user", "m_id")


def net_rows(linked_rows: DataFrame) -> DataFrame:
    """Spending rows of linked() with ``net``, what their refunds leave of them; those that net to nothing vanish."""
    net = F.col("amount") - F.coalesce("refunded", F.lit(0).cast("decimal(18,2)"))
    return linked_rows.where(spending()).withColumn("net", F.greatest(net, F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)")).where("net > 0")


def marked(rows: DataFrame, links_scope: DataFrame | None = None) -> DataFrame:
    """Rows that have ``refund_for`` with ``refunded``, what credits of the scope give back to them.

    links_scope: the rows whose links count, by default ``rows`` themselves.
    """
    return rows.join(offsets(rows if links_scope is None else links_scope), ["user_id", "id"], "left")


def netted(rows: DataFrame, links_scope: DataFrame | None = None) -> DataFrame:
    """Spending rows with ``net`` after linked refunds (never negative); rows that net to nothing vanish."""
    return net_rows(marked(rows, links_scope)).drop("refunded")
