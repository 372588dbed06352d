"""Matches in order of arrival and the events made of them, against plain versions that take one row after the other."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import components, events, matching
from quillon.sources.batches import Snapshot

DAY = dt.date(2026, 1, 5)
OLD = "user_id long, id string, direction string, amount int, date date, ids array<string>"
NEW = "user_id long, id string, nth long, direction string, amount int, date date, ids array<string>"


def in_turn(incoming, existing):
    out, claimed = set(), set()
    for user, id_, _, direction, amount, date, ids in sorted(incoming, key=lambda r: (r[2], r[1])):
        met = [(e, min((i for i, k in enumerate(ids) if k in (e[5] or [])), default=None)) for e in existing if e[0] == user and (e[0], e[1]) not in claimed] if ids else []
        met = [(e, p) for e, p in met if p is not None]
        agreeing = [(abs((e[4] - date).days), p, e[1]) for e, p in met if e[2] == direction and e[3] == amount and abs((e[4] - date).days) <= 2]
        if agreeing:
            gap, _, best = min(agreeing)
            out.add((user, id_, best, "matched", 0.99 if gap <= 1 else 0.95))
        elif met:
            best = min((p, e[1]) for e, p in met)[1]
            out.add((user, id_, best, "potential", 0.5))
        else:
            continue
        claimed.add((user, best))
    return out


def found(spark, incoming, existing):
    got = matching.shared_id_matches(spark.createDataFrame(incoming, NEW), spark.createDataFrame(existing, OLD))
    return {(r.user_id, r.incoming, r.existing, r.status, r.confidence) for r in got.collect()}


def test_a_row_whose_best_is_taken_gets_its_next(spark):
    existing = [(1, "e1", "debit", 10, DAY, ["k1"]), (1, "e2", "debit", 10, DAY + dt.timedelta(1), ["k2"])]
    incoming = [(1, "i1", 1, "debit", 10, DAY, ["k1", "k2"]), (1, "i2", 2, "debit", 10, DAY, ["k1", "k2"]), (1, "i3", 3, "debit", 10, DAY, ["k1", "k2"])]
    assert found(spark, incoming, existing) == {(1, "i1", "e1", "matched", 0.99), (1, "i2", "e2", "matched", 0.99)}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_against_turns(spark, seed):
    rng = random.Random(seed)
    ids = lambda user: [f"{user}k{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
    rest = lambda: (rng.choice(["debit", "credit"]), rng.randrange(1, 3), DAY + dt.timedelta(rng.randrange(5)))
    existing = [(u := rng.randrange(3), f"e{i:03}", *rest(), ids(u)) for i in range(120)]
    incoming = [(u := rng.randrange(3), f"i{i:03}", i // 2, *rest(), ids(u)) for i in range(120)]
    incoming += [(1, "n1", 1, None, 1, DAY, ["1k1"]), (None, "n2", 1, "debit", 1, DAY, ["1k1"]), (1, "n3", 1, "debit", 1, None, ["1k1"]), (1, "n4", 1, "debit", 1, DAY, None)]
    want = in_turn([r for r in incoming if r[1][0] == "i"], existing)
    assert found(spark, incoming, existing) == want and len({w[3:] for w in want}) == 3


def test_components(spark):
    edges = [(f"p{i}", f"p{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")] + [("hub", f"s{i}") for i in range(50)]
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"p{i}": "p0" for i in range(1, 10)} | {"y": "x"} | {f"s{i}": "hub" for i in range(50)}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


PRIORITY = {"bank": 0, "card": 1, "wallet": 2}
ROW = "user_id long, id string, source string, statement_id string, category string, subcategory string, merchant string, notes string, edited boolean, time string, counterparty string"
MATCH = "user_id long, incoming string, existing string, status string, confidence double"
DECISION = "user_id long, a string, b string, action string"


def derived(rows, matches, decisions):
    """Events by taking links one after the other."""
    at = {(r[0], r[1]): r for r in rows}
    apart = {(u, *sorted((a, b))) for u, a, b, action in decisions if action == "separate"}
    surety = {}
    for u, a, b, action in decisions:
        if action == "merge":
            surety[u, *sorted((a, b))] = 2.0
    pending = set()
    for u, a, b, status, sure in matches:
        pair = (u, *sorted((a, b)))
        if status == "matched":
            surety[pair] = max(surety.get(pair, 0), sure)
        else:
            pending.add(pair)
    whole = lambda p: (p[0], p[1]) in at and (p[0], p[2]) in at and p not in apart
    group = {k: frozenset([k]) for k in at}
    waits = {p for p in pending if whole(p) and p not in surety}
    for pair, _ in sorted(((p, s) for p, s in surety.items() if whole(p)), key=lambda x: (-x[1], x[0])):
        x, y = group[pair[0], pair[1]], group[pair[0], pair[2]]
        if x is not y and {at[k][2] for k in x} & {at[k][2] for k in y}:
            waits.add(pair)
        elif x is not y:
            for k in x | y:
                group[k] = x | y
    waits = {p for p in waits if p not in surety or group[p[0], p[1]] is not group[p[0], p[2]]}
    out = {}
    for k, members in group.items():
        ranked = sorted(members, key=lambda m: (PRIORITY[at[m][2]], m[1]))
        first, row = ranked[0], list(at[k])
        if k == first:
            if not row[8]:
                edit = next((at[m] for m in ranked if at[m][8]), None)
                if edit:
                    row[4:9] = [edit[4], edit[5], edit[6], row[7] if row[7] is not None else edit[7], True]
            for c in (9, 10):
                row[c] = next((at[m][c] for m in ranked if at[m][c] is not None), None)
        others = sorted(m[1] for m in members if m != k)
        open_ = sorted({p[2] if p[1] == k[1] else p[1] for p in waits if p[0] == k[0] and k[1] in p[1:]})
        status = "matched" if others else "potential" if open_ else None
        out[k] = (*row, min(m[1] for m in members), k == first, status, (others or open_ or [None])[0])
    return out


def drawn(seed):
    rng = random.Random(seed)
    rows = []
    for u, i in itertools.product(range(4), range(14)):
        edited = rng.random() < 0.3
        rows.append((u, f"r{i:02}", rng.choice(list(PRIORITY)), f"s{rng.randrange(3)}", f"c{i}", None, f"m{i}", rng.choice([None, "n"]), edited, rng.choice([None, f"{i:02}:00"]), rng.choice([None, f"p{i}"])))
    pick = lambda: rng.sample([f"r{i:02}" for i in range(15)], 2)
    matches = [(rng.randrange(4), *pick(), *rng.choice([("matched", 0.99), ("matched", 0.95), ("potential", 0.5)])) for _ in range(50)]
    decisions = [(rng.randrange(4), *pick(), rng.choice(["merge", "separate"])) for _ in range(10)]
    decisions += [(u, a, b, rng.choice(["merge", "separate"])) for u, a, b, *_ in matches[:8]]
    return rows, matches, decisions


def test_events_against_links_in_turn(spark):
    rows, matches, decisions = drawn(3)
    got = events.events(spark.createDataFrame(rows, ROW), spark.createDataFrame(matches, MATCH), spark.createDataFrame(decisions, DECISION), PRIORITY)
    want = derived(rows, matches, decisions)
    assert {(r.user_id, r.id): tuple(r) for r in got.collect()} == want
    assert {w[-2] for w in want.values()} == {"matched", "potential", None} and max(sum(x[11] == w[11] for k, x in want.items() if k[0] == j[0]) for j, w in want.items()) == 3


def test_a_deleted_statement(spark, tmp_path):
    """Repairing the touched users gives what a rebuild without the statement gives, and other users' files stay."""
    rows, matches, decisions = drawn(5)
    frames = [spark.createDataFrame(x, schema) for x, schema in ((rows, ROW), (matches, MATCH), (decisions, DECISION))]
    table = Snapshot(str(tmp_path / "events"), ("user_id", "id"), buckets=16, by=("user_id",))
    table.create(events.events(*frames, PRIORITY))
    done = events.without_statement(table, *frames, spark.createDataFrame([(2, "s1")], "user_id long, statement_id string"), PRIORITY)
    left = [r for r in rows if not (r[0] == 2 and r[3] == "s1")]
    want = derived(left, matches, decisions)
    assert {(r.user_id, r.id): tuple(r) for r in table.read(spark).collect()} == want
    assert done.buckets == 1 and done.bytes_read < done.bytes_before
    assert events.events(*[f.where("false") for f in frames], PRIORITY).count() == 0
    alone = events.events(frames[0], frames[1].where("false"), frames[2].where("false"), PRIORITY).where(F.col("is_primary") & F.col("match_status").isNull() & (F.col("event_id") == F.col("id")))
    assert alone.count() == len(rows)
