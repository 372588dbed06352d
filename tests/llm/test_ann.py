import numpy as np
from pyspark.sql import functions as F

from quillon.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k, every):
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in kept:
        if q % every == 0:
            best = {}
            for c, b in kept:
                if c != q and len(a) == len(b):
                    best[c] = max(best.get(c, -np.inf), float(a @ b))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df, k=10, **options):
    out = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k, **options).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    """Unlike norms, so nearest by inner product is not nearest by distance."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.3, 2)).tolist()) for i in range(3000)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA).repartition(3)
    got, want = found(df, ef=48), brute(rows, 10, 20)
    assert set(got) == set(want)
    hits = [len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(w) for q, w in brute(rows, 3000, 20).items()}
    assert all(abs(exact[q][c] - s) < 1e-9 for q in got for c, s in got[q])


def test_recall_of_the_query(spark):
    """The registered query, with its own parameters, on its whole table."""
    from quillon.llm.registry import op2_ann

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute(rows, 20, 20), {}
    for r in op2_ann(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == set(want) and np.mean([len(got[q] & {c for c, _ in w}) / len(w) for q, w in want.items()]) >= 0.9


def test_common_vector_and_full_answers(spark, monkeypatch):
    """A vector that half of the rows have fills lists in parts; each query still gets k, from all lists if need be."""
    monkeypatch.setattr(ann, "PART", 0.02)
    rng = np.random.default_rng(5)
    rows = [(i, (np.ones(8) if i % 2 else rng.normal(size=8)).tolist()) for i in range(1200)]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows] + [(None, [9.0] * 8, 0, "")], SCHEMA).repartition(3)
    for k, reach in ((10, 0.6), (300, 0.0)):
        got, want = found(df, k, reach=reach, ef=4), brute(rows, k, 20)
        assert {q: len(w) for q, w in got.items()} == {q: k for q in want}
    assert all(c is not None for w in got.values() for c, _ in w)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(15)] + [(20, rows[20][1]), (200, None), (201, []), (202, [0.0] * 8), (203, [float("nan")] * 8), (204, [None] * 8), (205, [1.0])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    got, want = found(df), brute([r for r in rows if not r[1] or len(r[1]) == 8], 10, 20)
    assert {q: [c for c, _ in w] for q, w in got.items()} == {q: [c for c, _ in w] for q, w in want.items()}
    assert found(spark.createDataFrame([], SCHEMA)) == {}
    assert found(spark.createDataFrame([(0, [1.0, 2.0], 0, ""), (1, [2.0, 1.0], 0, "")], SCHEMA)) == {0: [(1, 4.0)]}
