import math
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from quillon.llm import lexical, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_terms_are_the_maximal_matches():
    texts = ["It's Élan—naïve_x 汉字 A1b2 \x00z\x7f", "", "a" * 600_000 + " B", "é" * 300_000]
    hashes, first = lexical.terms(pa.array(texts))
    want = [terms(t) for t in texts]
    assert list(first) == [0, *[sum(map(len, want[: i + 1])) for i in range(len(want))]]
    flat = [t for w in want for t in w]
    single, _ = lexical.terms(pa.array([" ".join(flat)]))
    assert list(single) == list(hashes) and len(set(hashes.tolist())) == len(set(flat))


@pytest.mark.parametrize(("block", "k"), [(1 << 20, 20), (500, 3), (1, 2)])
def test_against_brute_force(spark, sf_dir, block, k):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = rows(lexical.rank(docs.repartition(3), items, k=k, block=block, item_bytes=2000))
    assert got == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()], k) and got


def test_stops_early_and_stays_exact(monkeypatch):
    """A rare term decides: most postings of the frequent ones are never read."""
    import numpy as np

    count, frequent = 20_000, 5
    rng = np.random.default_rng(5)
    lengths = rng.integers(50, 500, count)
    term = np.concatenate([np.r_[np.arange(frequent), [frequent] if d < 30 else []] for d in range(count)]).astype(np.int64)
    counts = np.array([frequent + (d < 30) for d in range(count)])
    tf = rng.integers(1, 9, len(term))
    block = lexical.Block(lengths, counts, term, tf, count, int(lengths.sum()), frequent + 1)
    weights = np.array([3, 3, 3, 3, 3, 9000])
    found, scores = block.best(np.arange(frequent + 1), weights, np.zeros(frequent + 1, np.int64), 20, 0)
    doc = np.repeat(np.arange(count), counts)
    exact = np.bincount(doc, weights[term] * block.impact, count).astype(np.int64)
    assert len(found) <= 40 and (scores == exact[found]).all()
    assert set(np.argsort(-exact, kind="stable")[:20]) <= set(found)


def test_sql_agrees_on_odd_tables(spark):
    docs = odd_docs(spark).withColumn("terms", F.lit("clash")).withColumn("n", F.lit(1))
    items = spark.createDataFrame([(1, "beta GAMMA text text"), (1, "beta GAMMA text text"), (2, None), (3, "?!"), (None, "naïve 汉字 word"), (4, "document id")], "item_id long, text string")
    got = rows(lexical.rank(docs, items))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    assert got == sorted(con.execute(registry.OP13_SQL).fetchall(), key=str) and len(got) > 8
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_empty(spark):
    items = spark.createDataFrame([(1, "beta")], "item_id long, text string")
    assert lexical.rank(empty_docs(spark), items).count() == 0
    assert lexical.rank(odd_docs(spark), items.where("false")).count() == 0
