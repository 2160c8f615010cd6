import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from spectrail.functions.scalars import bin_of, edges
from spectrail.operators import distribution as d

NAN = float("nan")


def _peaks(spark, rows):
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "fragment_idx long, score double, intensity long")


def test_edges_ignore_nan(spark):
    axis = d.score_axis(_peaks(spark, [(1.0, 1), (NAN, 1), (3.0, 1)]))
    assert axis.n == 2 and axis.edges[0] == 1 and axis.edges[-1] == 3


def test_histogram_on_edges(spark):
    rows = d.histogram(_peaks(spark, [(0.2, 1), (NAN, 1), (1.5, 1), (2.8, 1), (NAN, 1)]), F.col("score"), d.Axis(0.0, 3.0, 3, 3)).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [1, 1, 1]


def test_degenerate_range(spark):
    peaks = _peaks(spark, [(1.0, 99), (NAN, 999), (1.0, 9999), (1.0, 99999)])
    mapping = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "pmsms_fragment_idx long, precursor_idx long")
    mapped = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "precursor_idx long, detected_charges long")
    found = d.slice_data("all", peaks, d.matched_peaks(peaks, mapping, mapped))
    assert found.score_axis.n == 3 and found.score_axis.width > 0
    total = found.scores.agg(F.sum("all_count"), F.sum("matched_count")).first()
    assert tuple(total) == (3, 2)


def test_empty_inputs_give_no_slices(spark):
    mapping = spark.createDataFrame([], "pmsms_fragment_idx long, precursor_idx long")
    mapped = spark.createDataFrame([], "precursor_idx long, detected_charges long")
    assert d.compare_scores(_peaks(spark, []), mapping, mapped) == []


def test_quantile_is_finite(spark):
    q = d.intensity_quantile(_peaks(spark, [(1.0, 9), (NAN, 5), (2.0, 999999999)]))
    assert math.isfinite(q) and q >= 1


def test_bins_agree_with_the_edges(spark):
    r = random.Random(4)
    for low, high, n in ((0.1, 0.7, 50), (-3.3, 12.9, 200), (1e-9, 3e-9, 100)):
        at = edges(low, high, n)
        values = at + [r.uniform(low, high) for _ in range(500)] + [low - 1, high + 1]
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", bin_of(F.col("v"), low, high, n).alias("b")).collect()
        for row in rows:
            expected = None if not low <= row.v <= high else min(bisect.bisect_right(at, row.v) - 1, n - 1)
            assert row.b == expected


def test_repeated_matches_can_outnumber_peaks(spark):
    a = spark.createDataFrame([(0, 1)], "bin int, count long")
    b = spark.createDataFrame([(0, 3), (1, 1)], "bin int, count long")
    assert sorted(r.unmatched_count for r in d.unmatched(a, b, ["bin"]).collect()) == [-2, -1]


def test_smoothing_keeps_the_sum(spark):
    axis = d.Axis(0.0, 1.0, 20, 1)
    cells = spark.createDataFrame([(0, 0, 4), (10, 19, 6)], "log_bin int, score_bin int, count long")
    assert abs(d.smoothed(cells, axis, axis).agg(F.sum("smooth")).first()[0] - 10) < 1e-9


def test_labels_and_messages():
    assert d.drop_message("scores", 5, 5) is None and "2 of 5" in d.drop_message("scores", 5, 3)
    label = d.plot_label("method", " | ".join(f"k{i}={i}" for i in range(40)), 1.23456)
    assert label.endswith("1.235") and max(map(len, label.split("\n"))) <= 80


def test_exact_quantiles_over_many_ranges(spark):
    import numpy as np

    r = np.random.default_rng(4)
    values = np.concatenate([r.normal(size=700), np.repeat(0.25, 300), [5.0]])
    rows = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
    levels = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    for per_task in (1_000_000, 90, 7):
        assert np.allclose(d.quantiles(rows, "x", levels, per_task), np.quantile(values, levels), rtol=0, atol=1e-12)
    assert d.quantiles(rows.limit(0), "x", levels) == [None] * 6


def test_draws_are_within_one_of_their_expectation(spark):
    weights = [0, 5, 0, 1, 1000, 7, None, 3, -4]
    cells = spark.createDataFrame([(i * 3000, w) for i, w in enumerate(weights)], "bin long, count long")
    for n, seed in ((200_000, 0), (10, 3), (1, 9)):
        found = {r.bin // 3000: r.draws for r in d.draws(cells, n=n, seed=seed).collect()}
        total = sum(w for w in weights if w and w > 0)
        assert sum(found.values()) == n
        assert all(abs(found[i] - n * max(w or 0, 0) / total) < 1 + 1e-9 for i, w in enumerate(weights)) and found[0] == found[6] == found[8] == 0
        assert found == {r.bin // 3000: r.draws for r in d.draws(cells.repartition(5), n=n, seed=seed).collect()}
    assert [r.draws for r in d.draws(cells.where("count = 0")).collect()] == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 100, 999])
def test_cuts_at_or_below(spark, n):
    cuts = [x * 0.5 for x in range(n)]
    values = [-1.0, -0.0, 0.0, 0.25, 0.5, n / 4, n / 2 - 0.5, n / 2, 1e9, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [(r.v, r.k) for r in df.select("v", d.cuts_at_or_below(F.col("v"), cuts).alias("k")).collect()]
    assert got == [(v, sum(c <= v for c in cuts)) for v in values]
