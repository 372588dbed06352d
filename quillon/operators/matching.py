"""One-to-one matches of two sources by shared payment ids, in order of arrival.

Incoming rows choose one after the other among the existing rows that share an
id with them and that no row before them has claimed: the nearest in time that
agrees in direction and amount, at most ``NEAR`` days away, else any other (a
potential match). So a row whose best partner is taken gets its next.

A choice depends on those before it only within a connected group of ids. Most
groups hold one incoming row, whose choice is a ranking by Spark. The other
groups are each read as one sorted stream: the existing rows, then the incoming
ones in their order. A step looks up claims by (id, direction, amount, day), so
a group takes time in proportion to its rows and no pairs are made. A group
that is one id of a very large number of rows is one task's stream.

Defined results: a row without ids, or with a null among user, direction, amount or date,
matches nothing; ties stand in the order of the incoming row's ids, then of the
existing rows' id; empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.components import components
from quillon.session import durable

#: Days apart for a match and for the sure one, and the three confidences.
NEAR, SURE_DAYS = 2, 1
SURE, LATE, UNSURE = 0.99, 0.95, 0.5
_MATCH = "user_id long, incoming string, existing string, gap int, agrees boolean"


def _grouped(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Both sides' rows that share an id with the other side, with the group of ids they belong to."""
    whole = F.col("user_id").isNotNull() & F.col("direction").isNotNull() & F.col("amount").isNotNull() & F.col("date").isNotNull()

    def side(frame: DataFrame, nth: object, comes: int) -> DataFrame:
        return frame.where(whole).select("user_id", F.lit(comes).alias("comes"), nth.alias("nth"), "id", "direction", F.col("amount").cast("decimal(18,2)").alias("amount"), "date", F.array_distinct(F.array_compact("ids")).alias("ids"))

    rows = side(existing, F.lit(0).cast("long"), 0).unionByName(side(incoming, F.col("nth").cast("long"), 1)).where(F.size("ids") > 0)
    keys = rows.select("user_id", "comes", F.explode("ids").alias("key"))
    shared = keys.groupBy("user_id", "key").agg(F.min("comes").alias("low"), F.max("comes").alias("high")).where("low < high").select("user_id", "key")
    held = rows.withColumn("key", F.explode("ids")).join(shared, ["user_id", "key"]).groupBy("user_id", "comes", "nth", "id", "direction", "amount", "date", "ids").agg(F.collect_set("key").alias("met"))
    held = durable(held.withColumn("ids", F.array_intersect("ids", "met")).drop("met"))
    name = lambda key: F.concat_ws(":", F.col("user_id").cast("string"), key)
    first = F.array_min("ids")
    edges = held.where(F.size("ids") > 1).select(name(first).alias("a"), F.explode(F.transform("ids", name)).alias("b"))
    roots = components(edges)
    return held.join(roots, name(first) == F.col("vertex"), "left").withColumn("group", F.coalesce("root", name(first))).drop("vertex", "root")


def _chosen_alone(rows: DataFrame) -> DataFrame:
    """The choice of the one incoming row of each group."""
    key = ["user_id", "group"]
    asks = rows.where("comes = 1").select(*key, F.struct("id", "direction", "amount", "date", "ids").alias("r"))
    met = rows.where("comes = 0").join(asks, key)
    gap = F.abs(F.datediff("date", "r.date"))
    agrees = (F.col("direction") == F.col("r.direction")) & (F.col("amount") == F.col("r.amount")) & (gap <= NEAR)
    place = F.array_min(F.transform(F.array_intersect("r.ids", "ids"), lambda k: F.array_position("r.ids", k)))
    ranked = met.where(place.isNotNull()).select("user_id", F.col("r.id").alias("incoming"), F.col("id").alias("existing"), gap.alias("gap"), agrees.alias("agrees"), place.alias("place"), "group")
    order = Window.partitionBy(*key).orderBy(F.desc("agrees"), F.when(F.col("agrees"), F.col("gap")), "place", "existing")
    return ranked.withColumn("first", F.row_number().over(order)).where("first = 1").select("user_id", "incoming", "existing", "gap", "agrees")


class _Free:
    """The unclaimed existing rows of one group."""

    def __init__(self) -> None:
        self.exact: dict[tuple, deque] = defaultdict(deque)
        self.any: dict[str, deque] = defaultdict(deque)
        self.claimed: set[str] = set()

    def add(self, id_: str, direction: str, amount: object, date: object, ids: list[str]) -> None:
        for key in ids:
            self.exact[key, direction, amount, date].append(id_)
            self.any[key].append((id_, date))

    def _first(self, waiting: deque, id_of: object) -> object:
        while waiting and id_of(waiting[0]) in self.claimed:
            waiting.popleft()
        return waiting[0] if waiting else None

    def claim(self, direction: str, amount: object, date: object, ids: list[str]) -> tuple[str, int, bool] | None:
        for gap in range(NEAR + 1):
            found = []
            for place, key in enumerate(ids):
                for days in {gap, -gap}:
                    at = (key, direction, amount, date + timedelta(days=days))
                    if at in self.exact and (id_ := self._first(self.exact[at], lambda x: x)) is not None:
                        found.append((place, id_))
            if found:
                id_ = min(found)[1]
                self.claimed.add(id_)
                return id_, gap, True
        for key in ids:
            if key in self.any and (held := self._first(self.any[key], lambda x: x[0])) is not None:
                self.claimed.add(held[0])
                return held[0], abs((held[1] - date).days), False
        return None


def _chosen_in_turn(rows: DataFrame) -> DataFrame:
    """The choices of the incoming rows of each group, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, free = None, _Free()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if at != (r["user_id"], r["group"]):
                    at, free = (r["user_id"], r["group"]), _Free()
                about = (r["direction"], r["amount"], r["date"], r["ids"])
                if not r["comes"]:
                    free.add(r["id"], *about)
                elif (got := free.claim(*about)) is not None:
                    out.append((r["user_id"], r["id"], *got))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["user_id", "incoming", "existing", "gap", "agrees"])

    order = ["user_id", "group", "comes", "nth", "id"]
    return rows.repartition("user_id", "group").sortWithinPartitions(*order).mapInArrow(run, _MATCH)


def shared_id_matches(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """user_id, incoming, existing, status, confidence: at most one match of each row.

    incoming: user_id, id, nth (order of arrival), direction, amount, date, ids;
    existing: the same without nth, of rows that may be matched (``available``).
    """
    rows = durable(_grouped(incoming, existing))
    asking = rows.where("comes = 1").groupBy("user_id", "group").agg(F.count("*").alias("asking"))
    # written before it is dealt out: Spark drops a repartition by a join's own key, and may then turn the join into one without it
    rows = durable(rows.join(asking, ["user_id", "group"]))
    met = _chosen_alone(rows.where("asking = 1")).unionByName(_chosen_in_turn(rows.where("asking > 1").drop("asking")))
    sure = F.when(~F.col("agrees"), UNSURE).when(F.col("gap") <= SURE_DAYS, SURE).otherwise(LATE)
    return met.select("user_id", "incoming", "existing", F.when(F.col("agrees"), "matched").otherwise("potential").alias("status"), sure.alias("confidence"))
