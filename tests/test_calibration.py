import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrail.operators import calibration as c


def _rows(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(600, 3600, n)
    y = 3 * np.sin(x / 500) + rng.normal(0, 0.2 + x / 6000, n)
    return x, y, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, expmass double, precursor_ppm double")


def _splines(x, low, high, knots=10):
    """The same basis by Cox and de Boor's recursion on extended knots, without the last column."""
    step = (high - low) / (knots - 1)
    t = low + step * np.arange(-2, knots + 2)
    x = np.clip(x, low, high)
    b = [(((x >= t[i]) & (x < t[i + 1]) & (x < high)) | ((i == knots) & (x == high))).astype(float) for i in range(len(t) - 1)]
    for k in (1, 2):
        b = [(x - t[i]) / (t[i + k] - t[i]) * b[i] + (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * b[i + 1] for i in range(len(b) - 1)]
    return np.array(b[: knots + 1]).T[:, :-1]


def _ridge(b, y):
    """Evidence maximisation on rows."""
    b = b / b.std(axis=0)
    mean = b.mean(axis=0)
    z, t = b - mean, y - y.mean()
    alpha, lam, old = 1 / t.var(), 1.0, None
    for _ in range(300):
        s = np.linalg.inv(lam * np.eye(z.shape[1]) + alpha * z.T @ z)
        w = alpha * s @ z.T @ t
        if old is not None and np.abs(w - old).sum() < 1e-3:
            break
        old = w
        gamma = z.shape[1] - lam * np.trace(s)
        lam, alpha = (gamma + 2e-6) / (w @ w + 2e-6), (len(t) - gamma + 2e-6) / (((t - z @ w) ** 2).sum() + 2e-6)
    return y.mean() + z @ w


def test_spline_equals_the_fit_on_rows(spark):
    x, y, df = _rows(spark)
    model = c.spline(df, "precursor_ppm")
    got = {r.i: r for r in model.predict(df).collect()}
    b = _splines(x, x.min(), x.max())
    center = _ridge(b, y)
    size = np.maximum(_ridge(b, np.abs(y - center)), 0)
    assert np.allclose([got[i].prediction for i in range(len(x))], center, atol=1e-5)
    assert np.allclose([got[i].high for i in range(len(x))], center + 2 * size, atol=1e-4)
    inside = np.mean([got[i].low <= y[i] <= got[i].high for i in range(len(x))])
    assert 0.85 < inside < 0.95 and all(0.1 < got[i].deviation < 2 for i in range(len(x)))


def test_splines_are_those_of_the_recursion(spark):
    xs = [500.0, 600.0, 601.5, 933.3333333333334, 1000.0, 3599.9, 3600.0, 4000.0]
    df = spark.createDataFrame([(x,) for x in xs], "expmass double")
    expected = _splines(np.array(xs), 600.0, 3600.0)
    full = np.column_stack([np.ones(len(xs)), expected, xs])
    assert np.allclose(c.gram(df, c.Basis(600.0, 3600.0), F.col("expmass"), "expmass"), full.T @ full, atol=1e-6)


def test_boosted_reaches_the_medians(spark):
    x, y, df = _rows(spark, 6000, 2)
    train, test = c.split(df, key="i")
    assert abs(train.count() / 6000 - 0.8) < 0.03
    assert {r.i for r in train.collect()} == {r.i for r in c.split(df, key="i")[0].collect()}
    model = c.boosted(train, "precursor_ppm")
    found = c.metrics_table(model.predict(test), "precursor_ppm").first()
    best = np.mean([abs(r.precursor_ppm - 3 * np.sin(r.expmass / 500)) for r in test.collect()])
    flat = np.mean(np.abs(y - np.median(y)))
    assert found.n == test.count() and best * 0.95 < found.mae < best * 1.15 < flat
    assert found.rmse >= found.mae and 0.6 < found.r2 < 1


def test_boosted_equals_rounds_on_rows():
    """Without thinning, counts give what signs and medians of all rows give."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, (12, 9))
    centers = np.sort(rng.normal(size=9))
    bins = np.repeat(np.arange(12), counts.sum(axis=1))
    y = np.concatenate([np.repeat(centers, row) for row in counts])
    lower = lambda v: np.sort(v)[(len(v) + 1) // 2 - 1]
    own = np.full(12, lower(y))
    for _ in range(40):
        res = y - own[bins]
        g = np.bincount(bins, np.sign(res), 12)
        leaf = c._grown(g, np.bincount(bins, minlength=12).astype(float), 3, 1.0)
        for k in range(leaf.max() + 1):
            own[leaf == k] += 0.05 * lower(res[leaf[bins] == k])
    assert np.allclose(c.boosted_bins(counts, centers, trees=40, depth=3, subsample=1.0), own)


def test_odd_rows(spark):
    rows = [(None, 1.0), (5.0, None), (float("nan"), 1.0), (5.0, float("inf")), (1.0, 2.0), (1.0, 2.0)]
    df = spark.createDataFrame(rows, "expmass double, y double")
    model = c.boosted(df, "y")
    assert [r.prediction for r in model.predict(df).collect()][:1] == [None] and model.predict(df.where("expmass = 1")).first().prediction == 2.0
    flat = c.spline(df, "y").predict(df.where("expmass = 1")).first()
    assert flat.prediction == pytest.approx(2.0) and flat.low == pytest.approx(2.0)
    none = df.where(F.lit(False))
    assert c.boosted(none, "y").predict(df.where("expmass = 1")).first().prediction == 0.0
    with pytest.raises(ValueError):
        c.spline(none, "y")
    assert c.metrics_table(model.predict(df.where("expmass = 1")), "y").first().r2 is None
