import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import registry, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, share=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, held in members.items():
        if node:
            kids[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(held) - 1) * words(node)
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(whole[c]) == len(node))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def query(spark, rows, block=200_000, parts=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return rows_of(trie.trie(df, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4, block=block))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def drawn(seed, convs, longest, alphabet):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-convs, 2 * convs), convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", None]), " ".join("w" for _ in range(rng.randint(0, alphabet)))))
    return rows


@pytest.mark.parametrize(("seed", "convs", "longest", "alphabet", "block"), [(1, 60, 5, 1, 3), (2, 80, 3, 0, 12), (3, 40, 9, 2, 30), (4, 25, 30, 0, 10)])
def test_many_blocks_against_brute_force(spark, seed, convs, longest, alphabet, block):
    rows = drawn(seed, convs, longest, alphabet)
    assert query(spark, rows, block) == brute(rows)


def test_copies_over_many_blocks(spark):
    """A long conversation that a third hold, one that goes on where it ends, and one that branches within."""
    same = [("user", f"turn {i} words") for i in range(40)]
    rows = []
    for c in range(0, 1200, 20):  # ids that take their own first turns
        turns = same[: 40 if c % 60 else 17] + ([("user", f"own {c}")] if c % 100 == 0 else [])
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    assert query(spark, rows, block=60) == brute(rows)


def test_query_and_sql(spark, sf_dir, tmp_path):
    got = rows_of(registry.op11_prefix_trie(spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute(rows) and len(got) > 50
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{sf_dir}/conversations.parquet'")
    assert sorted(con.execute(registry.OP11_SQL).fetchall(), key=str) == got


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 2, "user", "x " * 50_000),
        (1, 5, "user", "one"), (3, 1, "", ""), (21, 0, "user", "alone"), (None, 0, "user", "no conversation"), (-7, 0, "user", "below zero"), (-7, None, None, None),
        (40, 1, "a", "tie"), (40, 1, "b", "tie"), (40, 1, "b", "tie"),
    ]
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("words", F.lit(2))
    got = rows_of(trie.trie(df, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4))
    assert got == want
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert sorted(con.execute(registry.OP11_SQL).fetchall(), key=str) == want
    plain = [r for r in rows if r[0] is not None]
    assert rows_of(trie.trie(spark.createDataFrame(plain, SCHEMA))) == brute(plain, share=False)


def test_empty(spark):
    assert query(spark, []) == []
    assert query(spark, [(None, 1, "user", "x")]) == []
    assert query(spark, [(1, 0, "user", "x"), (2, 0, "user", "x")], parts=7) == brute([(1, 0, "user", "x"), (2, 0, "user", "x")])
