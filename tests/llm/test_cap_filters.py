"""Recall of the filter code at the threshold itself, for few and many dimensions and any size of the code."""

import numpy as np
import pytest

from siftwave.llm.cap_filters import ProductCode, link_vectors


def planted(rng, n, dim, cosine):
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [2, 3, 4, 8, 64, 384])
@pytest.mark.parametrize("n", [10, 100_000, 10**9])
def test_recall_at_the_threshold(dim, n):
    code, relevant = ProductCode.fitted(dim, n, 0.93)
    x, y = planted(np.random.default_rng(5), 300, dim, 0.932)
    lists = [[set(code.best(own, relevant)) for own in zip(*code.parts(v), strict=True)] for v in (x, y)]
    assert all(len(a) >= 4 for a in lists[0])
    assert np.mean([not a.isdisjoint(b) for a, b in zip(*lists, strict=True)]) >= 0.95


@pytest.mark.parametrize("dim", [2, 3, 4, 16])
def test_links_in_few_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    x, y = planted(rng, 150, dim, 0.95)
    v = np.vstack([x, y, [np.eye(dim)[0]], [np.eye(dim)[0] + 1e-300 * np.eye(dim)[1]]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, a.tolist(), 1) for i, a in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in link_vectors(rows).collect()}
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()
    assert found[300] >= 1 and found[301] >= 1
