import random

import numpy as np
import pytest
from helpers import empty_docs, odd_docs
from pyspark.sql import functions as F

from quillon.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    common = [f"plain{i}" for i in range(300)]
    bad = ["vile", "vileness", "grubbish", "grubby", "mucky"]
    docs, labels = [], []
    for i in range(500):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 120))]
        toxic = i % 4 == 0
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad).capitalize() + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_evidence(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert len(rows) == 100 and all(0 <= r.score <= 1 for r in rows)
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) >= 97
    assert all(e.label == 1 or e.similarity < 1.0001 for r in rows for e in r.evidence) and all(len(r.evidence) <= 15 for r in rows)
    assert not {e.doc_id for r in rows for e in r.evidence} & {r.doc_id for r in rows}


def test_block_max_search_is_exact(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.lit(True), least_ratio=0.5)
    import pyarrow as pa

    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    vectors = model.vectors(pa.array(texts))
    dense = np.zeros((len(texts), len(model.vocabulary)))
    for i, (number, weight) in enumerate(vectors):
        dense[i, number] = weight
    by_id = {int(d): i for i, d in enumerate(model.ids)}
    examples = dense[[int(d) for d in model.ids]]
    for i in range(0, 500, 7):
        cosines = examples @ dense[i]
        want = sorted(((-round(c, 12), int(g), int(d)) for c, g, d in zip(cosines, model.digests, model.ids, strict=True) if c > 0))[:15]
        rows, scores = model.nearest(*vectors[i])
        assert [(-round(s, 12), int(model.digests[r]), int(model.ids[r])) for r, s in zip(rows, scores, strict=True)] == want
        but, _ = model.nearest(*vectors[i], toxicity.digests(pa.array(texts[i : i + 1]))[0])
        assert i not in model.ids[but] and set(but[:14]) >= {r for r in rows if model.ids[r] != i and r in rows[:14]}
    assert len(by_id) == 500


def test_odd_rows(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(None, 1, 1), (3, 1, None), (9999, 1, 1)], LABELS)), F.lit(True))
    rows = toxicity.score(odd_docs(spark), model).collect()
    assert len(rows) == 9 and all(r.score < 0.5 for r in rows)
    assert toxicity.score(empty_docs(spark), model).count() == 0
    nothing = toxicity.fit(docs, spark.createDataFrame([], LABELS), F.lit(True))
    assert {r.score for r in toxicity.score(odd_docs(spark), nothing).collect()} == {0.0}


def test_neither_ids_nor_own_labels_count(spark, corpus):
    """Other ids, and copies of an example under a new id, get the same scores."""
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    again = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("doc_id", F.col("doc_id") + 10_000), model).collect()}
    assert again == {i + 10_000: s for i, s in score.items()}


def test_near_copies_count_once(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(i, f"{long} end", "", "", 0) for i in range(5)] + [(5, "another text of its own", "", "", 0), (6, "", "", "", 0), (7, None, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert toxicity._distinct(docs.select("doc_id", "text")) == {0, 5, 6, 7}
