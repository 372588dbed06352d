import math
from collections import Counter, defaultdict

from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from quillon.llm import mixing


def brute_targets(sizes, share, cap, weights):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets_and_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.sample(docs, mixing.words(F.col("text")), seed=3).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = brute_targets(sizes, 1.5, 2.0, (5, 2, 1))
    taken = defaultdict(int)
    for r in rows:
        assert math.isclose(r.target, want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    assert len(rows) == docs.count()


def test_odd_rows_and_reruns(spark):
    docs = odd_docs(spark).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    size = mixing.words(F.col("text"))
    one, two = (sorted(map(str, mixing.sample(docs, size).collect())) for _ in range(2))
    assert one == two and len(one) == 9
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in mixing.sample(docs, size).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies


def test_mix_does_not_depend_on_the_layout(spark):
    rows = [(i % 5 if i % 3 else None, f"text {i} words", "en", "s", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixes = [sorted(r.text for r in mixing.mix(d, share=0.7, seed=4).collect()) for d in (docs.repartition(1), docs.repartition(7, "n_chars"), docs.orderBy(F.desc("n_chars")))]
    assert mixes[0] == mixes[1] == mixes[2] and len(mixes[0]) == 42


def test_empty(spark):
    assert mixing.sample(empty_docs(spark), mixing.words(F.col("text"))).count() == 0
    assert mixing.mix(empty_docs(spark)).count() == 0
