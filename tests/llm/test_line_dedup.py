import random

from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from quillon.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def norm(line):
    return tuple("".join(c.lower() if c.isascii() else c for c in w) for w in line.split())


def brute(rows, min_words):
    """{doc_id: removed line numbers}: lines in stretches of enough words that any document of smaller id holds."""
    out, earlier = {}, set()
    for i in sorted({i for i, _ in rows}):
        fresh = set()
        for t in {t for j, t in rows if j == i}:
            lines = [(k, norm(x)) for k, x in enumerate(t.split("\n")) if norm(x)]
            gone = set()
            for a in range(len(lines)):
                for b in range(a + 1, len(lines) + 1):
                    stretch = tuple(x for _, x in lines[a:b])
                    if sum(map(len, stretch)) >= min_words:
                        fresh.add(stretch)
                        if stretch in earlier:
                            gone |= {k for k, _ in lines[a:b]}
            if gone:
                out[i] = sorted(gone)
        earlier |= fresh
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 9))]
        if rows and rng.random() < 0.5:
            old = rows[rng.randrange(len(rows))][1].split("\n")
            a = rng.randrange(len(old))
            lines[1:1] = old[a : a + 5]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA).repartition(3)
    for min_words in (6, 12, 20):
        want = brute(rows, min_words)
        got = {r.doc_id: r.removed for r in line_dedup.dedup(docs, min_words).where("removed IS NOT NULL").collect()}
        assert got == want and len(want) > 8


def test_real_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 20)
    out = line_dedup.dedup(docs).collect()
    assert {r.doc_id: r.removed for r in out if r.removed} == want and want
    text = dict(rows)
    for r in out:
        lines = [x for k, x in enumerate(text[r.doc_id].split("\n")) if k not in want.get(r.doc_id, [])]
        assert r.text == (text[r.doc_id] if r.doc_id not in want else "\n".join(lines) if any(x.strip() for x in lines) else "")


def test_patience_keeps_order():
    a, b = list("xabcyz1def"), list("abcq1zdefx")
    pairs = line_dedup._aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert line_dedup.common_blocks(a, b, [1] * 10, 3) == [1, 2, 3, 7, 8, 9]
    moved = list("abcdefgh"), list("efghabcd")  # one half is aligned, the other stands in another order
    assert line_dedup.common_blocks(*moved, [1] * 8, 4) == list(range(8))


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("removed", F.lit("clash")).withColumn("g_id", F.lit(1)).withColumn("key", F.lit(2))
    out = line_dedup.dedup(docs, min_words=8)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "g_id", "key", "removed"]
    rows = out.collect()
    assert len(rows) == 9 and sorted(r.doc_id for r in rows if r.removed) == [5, 5]
    assert {r.text for r in rows if r.doc_id == 5} == {""} and [r.text for r in rows if r.doc_id == 2] == [None]
    assert line_dedup.dedup(empty_docs(spark)).count() == 0


def test_frequent_single_line(spark):
    common = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"before {i}\n{common}\nafter {i}", "", "", 0) for i in range(70)]
    out = {r.doc_id: r.removed for r in line_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {0: None} | {i: [1] for i in range(1, 70)}


def test_blocks_of_later_holders(spark):
    """A block is found though its first holder has only a part of it, and whatever number holds a line."""
    line = {k: " ".join(f"{k}{j}" for j in range(8)) for k in "abcde"}
    pad = lambda i: f"own {i}\n"
    rows = [(1, pad(1) + "\n".join(line[k] for k in "ab")), (2, pad(2) + "\n".join(line[k] for k in "bc")), (3, pad(3) + "\n".join(line[k] for k in "abc")), (4, pad(4) + "\n".join(line[k] for k in "abc"))]
    out = {r.doc_id: r.removed for r in line_dedup.dedup(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], SCHEMA)).collect()}
    assert out == {1: None, 2: None, 3: None, 4: [1, 2, 3]}
