import numpy as np
from pyspark.sql import functions as F

from quillon.llm import exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k, every):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in kept:
        if q is not None and q % every == 0:
            best = {}
            for c, b in kept:
                if c != q and len(a) == len(b):
                    best[c] = max(best.get(c, -(10**18)), int(a @ b))
            for rank, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
                out.add((q, rank, c, s))
    return out


def found(df, **options):
    return {tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 5 == 0, k=5, **options).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "ROWS", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=40)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(12)]  # ties
    rows += [(7, rows[7][1]), (500, None), (501, []), (502, [None] * 40), (503, [float("nan")] * 40), (504, [float("inf")] * 40), (505, [0.0] * 40), (506, [1.0, 2.0]), (510, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows] + [(None, [9.0] * 40, 0, "x")], SCHEMA).repartition(3)
    assert found(df) == brute(rows, 5, 5)
    monkeypatch.setattr(exact_topk, "HELD", 2)
    assert found(df, query_rows=8, groups=3) == brute(rows, 5, 5)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.5], 0, ""), (1, [0.25, 0.5], 0, "")], SCHEMA)
    assert found(few) == {(0, 1, 1, 256 * 64 + 128 * 128)}
    assert found(spark.createDataFrame([], SCHEMA)) == set()
