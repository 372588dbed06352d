"""Payments that several sources tell of: events as a derivation of rows, matches and the user's decisions.

Nothing is updated in place. An event is a group of rows linked by matches that
hold: made by a shared id, or decided by the user (``merge``), and not taken
back by the user (``separate``). An event has one row of each source at most:
where a group of links would break this, links are taken in order of their
surety, decisions first, and one that would bring a second row of a source into
an event stays a potential match. One row is primary, of the source of highest
priority; what the user has edited in another row, and what the primary row
does not know, is carried over to it.

Rows: user_id, id, source, statement_id, category, subcategory, merchant, notes,
edited (boolean), time, counterparty; further columns are kept as they are.
Matches: user_id, incoming, existing, status, confidence. Decisions: user_id,
a, b, action.

Defined results: links to rows that are not there fall away, links with a null
as well; of several decisions on a pair a separation holds; rows are told apart
by (user_id, id); empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.components import components
from quillon.session import durable
from quillon.sources.batches import Rewritten, Snapshot

#: What the user may have changed in a row, and what a row may know that others do not.
EDITS = ("category", "subcategory", "merchant", "notes")
FACTS = ("time", "counterparty")
#: The columns that events() adds to a row.
DERIVED = ("event_id", "is_primary", "match_status", "match_with")


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def links(rows: DataFrame, matches: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that may hold, pairs left to the user), both (user_id, a, b, surety, a_source, b_source), of rows that are there."""
    decided = decisions.where("a <> b").groupBy("user_id", *_pair(F.col("a"), F.col("b"))).agg(F.max(F.col("action") == "separate").alias("apart"), F.max(F.col("action") == "merge").alias("merge"))
    told = matches.where("incoming <> existing").groupBy("user_id", *_pair(F.col("incoming"), F.col("existing"))).agg(F.max(F.when(F.col("status") == "matched", F.col("confidence"))).alias("confidence"))
    both = told.join(decided, ["user_id", "a", "b"], "full").where("NOT coalesce(apart, false)")
    names = rows.select("user_id", "id", "source")
    for side in ("a", "b"):
        both = both.join(names.withColumnsRenamed({"id": side, "source": f"{side}_source"}), ["user_id", side])
    both = both.withColumn("surety", F.when(F.col("merge"), 2.0).otherwise(F.col("confidence")))
    kept = ["user_id", "a", "b", "surety", "a_source", "b_source"]
    return both.where("surety IS NOT NULL").select(kept), both.where("surety IS NULL").select(kept)


def _name(id_: Column) -> Column:
    return F.concat_ws("\u0001", F.col("user_id").cast("string"), id_)


def _joined_in_order(crowded: DataFrame) -> DataFrame:
    """(user_id, id, event): groups in which a source occurs twice, link by link; a group is one sorted stream.

    crowded is a written frame: Spark drops a repartition by a join's own key, and may then turn the join into one without it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, event, sources = None, {}, {}

        def told() -> pa.RecordBatch:
            users, ids, events = zip(*((now[0], i, e) for i, e in event.items()), strict=True) if event else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(users, pa.int64()), pa.array(ids, pa.string()), pa.array(events, pa.string())], names=["user_id", "id", "event"])

        for batch in batches:
            for user, group, a, b, a_source, b_source in zip(*(batch.column(c).to_pylist() for c in ("user_id", "root", "a", "b", "a_source", "b_source")), strict=True):
                if now != (user, group):
                    if event:
                        yield told()
                    now, event, sources = (user, group), {}, {}
                for id_, source in ((a, a_source), (b, b_source)):
                    if id_ not in event:
                        event[id_] = id_
                        sources[id_] = ({source}, [id_])
                x, y = sorted((event[a], event[b]))
                if x != y and not sources[x][0] & sources[y][0]:
                    held, ids = sources.pop(y)
                    sources[x][0].update(held)
                    sources[x][1].extend(ids)
                    for id_ in ids:
                        event[id_] = x
        yield told()

    order = ["user_id", "root", F.desc("surety"), "a", "b"]
    return crowded.repartition("user_id", "root").sortWithinPartitions(*order).mapInArrow(run, "user_id long, id string, event string")


def _ends(holding: DataFrame, *keep: str) -> DataFrame:
    """(user_id, id, source) of both rows of each link."""
    sides = F.array(*[F.struct(F.col(x).alias("id"), F.col(f"{x}_source").alias("source")) for x in ("a", "b")])
    return holding.select("user_id", *keep, F.explode(sides).alias("r")).select("user_id", *keep, "r.*")


def identities(rows: DataFrame, holding: DataFrame) -> DataFrame:
    """(user_id, id, event): the event of each linked row, named by its least row id.

    Links whose rows have no other link, nearly all, are events as they are;
    only the rest is put together into groups.
    """
    degree = _ends(holding).groupBy("user_id", "id").agg(F.count("*").alias("n"))
    for side in ("a", "b"):
        holding = holding.join(degree.withColumnsRenamed({"id": side, "n": f"n_{side}"}), ["user_id", side])
    alone = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    holding = durable(holding)
    pairs = holding.where(alone & ~F.col("a_source").eqNullSafe(F.col("b_source"))).select("user_id", F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("event"))
    chained = holding.where(~alone)
    if not chained.head(1):
        return pairs
    roots = components(chained.select(_name(F.col("a")).alias("a"), _name(F.col("b")).alias("b")))
    linked = chained.join(roots, _name(F.col("a")) == F.col("vertex"), "left").withColumn("root", F.coalesce("root", _name(F.col("a")))).drop("vertex")
    ends = _ends(linked, "root").distinct()
    crowd = ends.groupBy("user_id", "root", "source").agg(F.count("*").alias("n")).groupBy("user_id", "root").agg((F.max("n") > 1).alias("crowded"))
    plain = ends.join(crowd.where("NOT crowded"), ["user_id", "root"]).select("user_id", "id", F.element_at(F.split("root", "\u0001"), -1).alias("event"))
    return durable(pairs.unionByName(plain).unionByName(_joined_in_order(durable(linked.join(crowd.where("crowded").drop("crowded"), ["user_id", "root"])))))


def events(rows: DataFrame, matches: DataFrame, decisions: DataFrame, priority: dict[str, int]) -> DataFrame:
    """``rows`` with event_id, is_primary, match_status ('matched', 'potential' or null), match_with, and what was carried over.

    priority: the place of each source, the first counts most. match_with: the
    row of the event, or of the pending match, with the least id besides its own.
    """
    holding, pending = links(rows, matches, decisions)
    holding = durable(holding)
    named = identities(rows, holding)
    rank = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in priority.items()], F.lit(len(priority)))
    placed = rows.join(named, ["user_id", "id"], "left").withColumn("event_id", F.coalesce("event", "id")).drop("event")
    event = Window.partitionBy("user_id", "event_id")
    whole = event.orderBy(rank, "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = placed.withColumns({"_nth": F.row_number().over(event.orderBy(rank, "id")), "_n": F.count("*").over(event), "_edit": F.first(F.when(F.col("edited"), F.struct(*EDITS)), ignorenulls=True).over(whole), "_ids": F.slice(F.sort_array(F.collect_list("id").over(event)), 1, 2)})
    facts = {c: F.first(c, ignorenulls=True).over(whole) for c in FACTS}
    primary = F.col("_nth") == 1
    carried = primary & ~F.coalesce("edited", F.lit(False)) & F.col("_edit").isNotNull()
    values = {c: F.when(carried, F.coalesce(F.col(c), F.col(f"_edit.{c}")) if c == "notes" else F.col(f"_edit.{c}")).otherwise(F.col(c)) for c in EDITS}
    values |= {c: F.when(primary, facts[c]).otherwise(F.col(c)) for c in FACTS}
    done = placed.withColumns(values | {"edited": F.coalesce("edited", F.lit(False)) | carried, "is_primary": primary})
    # a link that did not hold, as its event has a row of that source, is left to the user too
    ends = [named.withColumnsRenamed({"id": side, "event": f"e{side}"}) for side in ("a", "b")]
    refused = holding.join(ends[0], ["user_id", "a"], "left").join(ends[1], ["user_id", "b"], "left").where("coalesce(ea, a) <> coalesce(eb, b)").select("user_id", "a", "b")
    open_ = pending.select("user_id", "a", "b").union(refused)
    open_ = open_.select("user_id", F.col("a").alias("id"), F.col("b").alias("other")).union(open_.select("user_id", F.col("b"), F.col("a"))).groupBy("user_id", "id").agg(F.min("other").alias("other"))
    done = done.join(open_, ["user_id", "id"], "left")
    partner = F.get(F.array_except("_ids", F.array("id")), F.lit(0))
    status = F.when(F.col("_n") > 1, "matched").when(F.col("other").isNotNull(), "potential")
    done = done.withColumns({"match_status": status, "match_with": F.when(F.col("_n") > 1, partner).otherwise(F.col("other"))})
    return done.select(*rows.columns, *DERIVED)


def without_statement(table: Snapshot, rows: DataFrame, matches: DataFrame, decisions: DataFrame, statements: DataFrame, priority: dict[str, int]) -> Rewritten:
    """Deletes statements (user_id, statement_id) from a table of events that is kept by user.

    rows, matches and decisions are those of before. Only buckets of users who
    hold such a statement are derived anew and written; their surviving rows
    become events of their own or promote another primary, pending matches with
    what is gone fall away.
    """
    spark = rows.sparkSession
    users = statements.select("user_id").distinct()
    touched = table.touched(users)
    mine = rows.where(table._bucket().isin(touched))
    left = mine.join(statements.select("user_id", "statement_id"), ["user_id", "statement_id"], "left_anti").select(*rows.columns)
    asked = [f.where(table._bucket().isin(touched)) for f in (matches, decisions)]
    return table.replace(spark, events(left, *asked, priority), touched)
