from collections import Counter
from math import log

import numpy as np
import pytest
from helpers import empty_docs, odd_docs

from quillon.llm import lm_score


def brute(rows, target, order, alpha):
    """{doc_id: (n_tokens, score)} with counters over tuples of words."""
    texts = [(i, ["".join(c.lower() if c.isascii() else c for c in w) for w in (t or "").split()]) for i, t in rows]
    counts = [Counter(), Counter()]
    for i, words in texts:
        tokens = ["<s>", *words, "</s>"] if words else []
        for m in range(1 + (i in target)):
            for k in range(1, order + 1):
                for at in range(len(tokens) - k + 1):
                    counts[m][tuple(tokens[at : at + k])] += 1
    total = [sum(n for g, n in c.items() if len(g) == 1 and g != ("<s>",)) for c in counts]
    scale = [total[1] / total[0], 1.0]

    def p(m, gram):
        if not gram:
            return 1 / (total[0] + 1)
        held = counts[m][gram] * scale[m]
        context = (counts[m][gram[:-1]] if len(gram) > 1 else total[m]) * scale[m]
        return (held + alpha * p(m, gram[1:])) / (context + alpha)

    out = []
    for i, words in texts:
        tokens = ["<s>", *words, "</s>"] if words else []
        grams = [tuple(tokens[max(0, at - order + 1) : at + 1]) for at in range(1, len(tokens))]
        out.append((i, len(words), sum(log(p(0, g)) - log(p(1, g)) for g in grams) / max(1, len(grams))))
    return out


@pytest.mark.parametrize(("order", "bucket", "asked"), [(2, 4 << 20, 10**6), (2, 9000, 700), (3, 20_000, 5000)])
def test_against_brute_force(spark, sf_dir, monkeypatch, order, bucket, asked):
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    monkeypatch.setattr(lm_score, "SLICE", asked)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(80)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, " ")]
    rows += rows[:3]
    target = {i for i, _ in rows[::3]}
    ids = spark.createDataFrame([(i,) for i in target] * 2, "doc_id long")
    got = sorted(tuple(r) for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ids, order=order).collect())
    want = sorted(brute(rows, target, order, 2.0))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-9)
    assert np.mean([s for i, n, s in got if i in target and n]) < np.mean([s for i, n, s in got if i not in target and n])


def test_counts_pack_and_unpack():
    counts = np.array([0, 1, 255, 256, 2**40 + 7], np.int64)
    assert (lm_score.unpacked(lm_score.packed(counts)) == counts).all() and len(lm_score.unpacked(b"")) == 0


def test_odd_rows(spark):
    target = spark.createDataFrame([(1,), (None,)], "doc_id long")
    docs = odd_docs(spark).selectExpr("*", "1 AS bucket", "2 AS t_id", "3 AS is_target", "4 AS score")
    rows = lm_score.score(docs, target).collect()
    assert len(rows) == 9 and all(np.isfinite(r.score) for r in rows) and {r.score for r in rows if r.doc_id in (2, 3)} == {0.0}
    assert {r.n_tokens for r in rows if r.doc_id == 7} == {3000}
    assert {r.score for r in lm_score.score(odd_docs(spark), target.where("doc_id = 77")).collect()} == {0.0}
    assert lm_score.score(empty_docs(spark), target).count() == 0


def test_texts_that_occur_twice_stand_apart(spark):
    """The background's counts are those of the whole corpus: what it holds twice is likelier to it."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 120)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i]) for i in range(100, 130)]
    score = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(90)], "doc_id long")).collect()}
    twice, once = [score[i] for i in range(100, 130)], [score[i] for i in range(130, 300)]
    assert np.mean([x > max(np.quantile(once, 0.95), 0) for x in twice]) > 0.9


def test_query_tells_small_scripts_apart(spark, tmp_path):
    from quillon.llm import registry

    latin = [(i, " ".join(chr(97 + (i + k) % 26) * 3 for k in range(60)) + "0123456789.,;:!?()[]{}<>/+*=#%&$@^~|_-" * 9) for i in range(20)]
    rows = [*latin, (100, "мама мыла раму " * 9), (101, "мама мыла раму " * 9 + "мама"), (102, "кофе стоит даром " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    score = {r.doc_id: r.score for r in registry.op6_lm_score(spark, str(tmp_path)).collect()}
    assert score[101] < 0 < score[102] and score[102] - score[101] > 1
