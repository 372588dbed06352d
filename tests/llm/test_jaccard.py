import random
import re
from collections import defaultdict

import pytest
from helpers import empty_docs, odd_docs

from quillon.llm import jaccard
from quillon.llm.components import components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute(rows, n, percent):
    """{doc_id: (n_shingles, component)} by all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, **options).collect()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_tables(spark, sf_dir, n, percent):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], n, percent)
    assert sum(i != c for i, (_, c) in want.items()) > 5
    assert found(docs, n=n, percent=percent) == want


@pytest.mark.parametrize(("seed", "often", "most_often", "long_list", "part"), [(1, 16, 10**6, 64, 10**6), (2, 3, 10**6, 6, 4), (3, 2, 0, 4, 10**6), (4, 3, 40, 5, 3)])
def test_groups_chains_and_shared_passages(spark, monkeypatch, seed, often, most_often, long_list, part):
    """Families of near copies, chains of ever more edits, boilerplate: every link counts, in hot lists too, whether the frequent set holds them or not."""
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(14)] for _ in range(3)]
    rows = []
    for size in (8, 30, 90, 170, 185, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        chain = base
        for k in range(14):
            star = list(base)
            for _ in range(rng.randrange(1 + size // 40)):
                star[rng.randrange(size)] = rng.choice(vocabulary)
            chain = list(chain)
            chain[rng.randrange(size)] = rng.choice(vocabulary)
            rows += [star, chain, base + rng.choice(passages)]
    rows += [rng.choice(passages) + rng.choice(passages)[: rng.randrange(4)] for _ in range(30)]
    rng.shuffle(rows)
    table = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert found(docs, n=4, percent=85, often=often, most_often=most_often, long_list=long_list) == brute(table, 4, 85)


def test_odd_rows(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd_docs(spark), n=4, percent=85).collect()}
    assert got[1] == got[5] == (5, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4)
    assert got[7] == (1, 7) and got[None][1] is None
    assert jaccard.near_duplicates(odd_docs(spark)).count() == 9


def test_one_id_with_several_texts(spark):
    """Rows that share an id are one document: it links by either text."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, b), (5, a), (5, b), (7, a), (9, "alone of its kind here"), (5, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).collect()}
    assert got == {(1, 27, 1), (5, 27, 1), (5, 0, 5), (7, 27, 1), (9, 2, 9)}


def test_empty(spark):
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {v: got.get(v, v) for v in root} == root


def join_rows(spark, since):
    """The most rows that one join made in the executions from ``since`` on, by Spark's own metrics."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for i in range(since, int(store.executionsCount())):
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while "Join" in node.name() and metrics.hasNext():
                metric = metrics.next()
                if metric.name() == "number of output rows" and (value := values.get(metric.accumulatorId())).isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def test_variants_below_the_threshold_do_not_meet_in_pairs(spark):
    """Texts that lack different lines of one original: few link, and no join makes rows for all pairs of them."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    lines = [[rng.choice(vocabulary) for _ in range(25)] for _ in range(12)]
    rows = []
    for _ in range(400):
        gone = set(rng.sample(range(12), 3))
        words = [w for k, line in enumerate(lines) if k not in gone for w in line]
        for _ in range(2):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    table = list(enumerate([" ".join(w for line in lines for w in line), *rows]))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    want = brute(table, 4, 85)
    assert 20 < sum(i != c for i, (_, c) in want.items()) < 390
    since = int(spark._jsparkSession.sharedState().statusStore().executionsCount())
    assert found(docs, n=4, percent=85) == want
    assert join_rows(spark, since) < 200_000
