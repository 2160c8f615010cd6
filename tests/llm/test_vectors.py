import numpy as np
import pytest

from spectrail.llm import vectors


def _data(seed, dim, n):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    near = base[r.integers(0, n // 4, n)] + r.normal(scale=0.25, size=(n, dim)) * r.choice([0, 0.5, 1, 1.3], (n, 1))
    return np.vstack([base, near, near[:7]]).astype(np.float32)


def brute(x, cosine):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= cosine
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        low = np.where(link, label[None, :], len(x)).min(1)
        new = np.minimum(label, low)
        if (new == label).all():
            return link.sum(1), label
        label = new


@pytest.mark.parametrize("dim,group", [(64, 16_384), (64, 40), (16, 16_384), (3, 16_384)])
def test_matches_brute_force(spark, dim, group):
    x = _data(3, dim, 120)
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<float>, copies string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, group=group).collect()}
    links, label = brute(x, 0.9)
    assert got == {i: (int(links[i]), int(label[i]), int(label[i]) == i) for i in range(len(x))}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1e-30, 0.0]), (11, [3e38, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect())
    assert got == sorted([(i, 5, 0) for i in (0, 1, 9, 9, 10, 11)] + [(i, 0, i) for i in (2, 3, 4, 5, 6, 7, 8)])
    assert vectors.near_vectors(df.limit(0)).count() == 0
