"""Exact neighbours against brute force, with vectors that have no direction, and the share of cells that queries look at."""

import numpy as np

from siftwave.operators.similar import knn


def brute(queries, corpus, k):
    out = {}
    for qi, q in queries:
        near = []
        for ci, c in corpus:
            if ci != qi and ok(q) and ok(c) and len(q) == len(c):
                a, b = (np.asarray(x, float) / np.abs(x).max() for x in (q, c))
                near.append((1 - a @ b / np.sqrt((a @ a) * (b @ b)), ci))
        out[qi] = sorted(near)[:k]
    return out


def ok(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(v)


def test_knn(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 16)) * 5
    rows = [(i, (centers[i % 12] + rng.standard_normal(16) * 0.3).tolist()) for i in range(1500)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [1.0, None] + [0.0] * 14), (9004, [float("nan")] * 16), (9005, [1.0, 2.0]), (9006, [2.0, 1.0]), (9007, [float("inf")] + [0.0] * 15), (9008, (np.array(rows[5][1]) * 1e200).tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = [r for r in rows if r[0] % 25 == 0 or r[0] >= 9000]
    queries = spark.createDataFrame(asked, "id long, v array<double>")
    for block in (8192, 200):
        got = {}
        shares = {}
        for r in knn(queries, df, 3, block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["hit_id"]))
            shares[r["query_id"]] = r["visited"]
        want = {q: hits for q, hits in brute(asked, rows, 3).items() if hits}
        assert got.keys() == want.keys()
        for q, hits in want.items():
            assert np.allclose([d for _, d, _ in sorted(got[q])], [d for d, _ in hits], atol=1e-12)
            assert [r for r, *_ in sorted(got[q])] == list(range(1, len(hits) + 1))
        if block == 200:
            assert np.mean([s for q, s in shares.items() if q < 9000]) < 0.5  # clusters: most cells are ruled out
    assert knn(queries, df.limit(0)).count() == 0 and knn(queries.limit(0), df).count() == 0
