"""Distributions of score and intensity, for all library peaks and for matched ones."""

from __future__ import annotations

import textwrap
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.functions.scalars import bin_of, edges, finite, log_intensity, widened
from spectrail.sources.shared import saved

BINS_1D, BINS_2D, BINS_FACET = 100, 200, 50


@dataclass(frozen=True)
class Axis:
    """An evenly binned range; ``n`` values of ``total`` rows were finite when it was measured."""

    low: float
    high: float
    bins: int
    n: int
    total: int = 0

    @property
    def edges(self) -> list[float]:
        return edges(self.low, self.high, self.bins)

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins

    def bin(self, x: Column) -> Column:
        return bin_of(x.cast("double"), self.low, self.high, self.bins)


def passes(threshold: float | None = None, score: str = "score", intensity: str = "intensity") -> Column:
    """Score and log-intensity are finite, the latter at least ``threshold`` where one is given."""
    log = log_intensity(F.col(intensity))
    good = finite(F.col(score).cast("double")) & finite(log)
    return good if threshold is None else good & (log >= F.lit(threshold))


def passing(peaks: DataFrame, threshold: float | None = None, score: str = "score", intensity: str = "intensity") -> DataFrame:
    """The peaks that pass."""
    return peaks.where(passes(threshold, score, intensity))


def ranges(peaks: DataFrame, threshold: float | None = None, score: str = "score", intensity: str | None = "intensity") -> DataFrame:
    """One row: score_min, score_max, log_min, log_max, n over finite values; without intensity, of the score alone."""
    if intensity is None:
        rows = peaks.where(finite(F.col(score).cast("double")))
        return rows.agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.count(F.lit(1)).alias("n"))
    rows = passing(peaks, threshold, score, intensity).withColumn("_log", log_intensity(F.col(intensity)))
    return rows.agg(F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.min("_log").alias("log_min"), F.max("_log").alias("log_max"), F.count(F.lit(1)).alias("n"))


def axes(peaks: DataFrame, threshold: float | None = None, bins: int = BINS_2D, score: str = "score", intensity: str = "intensity") -> tuple[Axis, Axis] | None:
    """Axes of score and log-intensity, by one pass that also counts all rows and returns one; None without a finite peak."""
    good, log = passes(threshold, score, intensity), log_intensity(F.col(intensity))
    only = lambda x: F.when(good, x)
    r = peaks.agg(F.min(only(F.col(score))).alias("a"), F.max(only(F.col(score))).alias("b"), F.min(only(log)).alias("c"), F.max(only(log)).alias("d"), F.count_if(good).alias("n"), F.count(F.lit(1)).alias("total")).first()
    if not r["n"]:
        return None
    return Axis(*widened(r["a"], r["b"]), bins, r["n"], r["total"]), Axis(*widened(r["c"], r["d"]), bins, r["n"], r["total"])


def score_axis(peaks: DataFrame, threshold: float | None = None, bins: int = BINS_1D, score: str = "score", intensity: str = "intensity") -> Axis | None:
    """The axis of finite scores; with a threshold, of those whose log-intensity reaches it."""
    r = ranges(peaks, threshold, score, None if threshold is None else intensity).first()
    return Axis(*widened(r["score_min"], r["score_max"]), bins, r["n"]) if r["n"] else None


def histogram(values: DataFrame, value: Column, axis: Axis) -> DataFrame:
    """(bin, low, high, count), a row for each bin, empty ones too. Finite values outside of the axis are in none."""
    counts = values.where(finite(value.cast("double"))).select(axis.bin(value).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = values.sparkSession
    edge = lambda k: F.when(k == axis.bins, F.lit(axis.high)).otherwise(F.lit(axis.low) + k * F.lit(axis.width))
    every = spark.range(axis.bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def histogram_2d(peaks: DataFrame, score_axis_: Axis, log_axis: Axis, threshold: float | None = None, score: str = "score", intensity: str = "intensity") -> DataFrame:
    """(log_bin, score_bin, count) of the cells that hold a peak."""
    rows = passing(peaks, threshold, score, intensity)
    cells = rows.select(log_axis.bin(log_intensity(F.col(intensity))).alias("log_bin"), score_axis_.bin(F.col(score)).alias("score_bin"))
    return cells.where("log_bin IS NOT NULL AND score_bin IS NOT NULL").groupBy("log_bin", "score_bin").agg(F.count(F.lit(1)).alias("count"))


def matched_peaks(library: DataFrame, mapping: DataFrame, mapped: DataFrame, distinct: bool = False) -> DataFrame:
    """Library peaks of the mapping's rows with the charges their precursor was found with.

    A peak comes as often as fragments matched it, or once where ``distinct``.
    """
    rows = mapping.select("pmsms_fragment_idx", "precursor_idx")
    rows = rows.distinct() if distinct else rows
    joined = rows.join(mapped.select("precursor_idx", F.col("detected_charges").alias("charge")), "precursor_idx", "left")
    return joined.join(library, F.col("pmsms_fragment_idx") == F.col("fragment_idx")).select("fragment_idx", "score", "intensity", "charge", "precursor_idx")


def charge_of_rows(mapped: DataFrame) -> DataFrame:
    """(mapping_row, charge): each precursor's charge for each of its rows in the mapping."""
    return mapped.select("mapped_idx", F.posexplode(F.array_repeat("detected_charges", F.col("mapped_cnt").cast("int"))).alias("_p", "charge")).select((F.col("mapped_idx") + F.col("_p")).alias("mapping_row"), "charge")


def unmatched(all_counts: DataFrame, matched_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of all and of matched peaks by cell and their difference, below zero where peaks were matched repeatedly."""
    a, b = all_counts.withColumnRenamed("count", "all_count"), matched_counts.withColumnRenamed("count", "matched_count")
    joined = a.join(b, keys, "full").select(*keys, F.coalesce("all_count", F.lit(0)).alias("all_count"), F.coalesce("matched_count", F.lit(0)).alias("matched_count"))
    return joined.withColumn("unmatched_count", F.col("all_count") - F.col("matched_count"))


def marginal(cells: DataFrame, key: str, *counts: str) -> DataFrame:
    """Sums of counts along one axis."""
    return cells.groupBy(key).agg(*[F.sum(c).alias(c) for c in counts])


def density(counts: DataFrame, count: str, width: float, out: str = "density") -> DataFrame:
    """Adds count / (total * width), zeros where the total is zero; counts below zero are taken as none.

    The total is a window over all rows, which are as many as the axis has bins.
    """
    positive = F.greatest(F.col(count), F.lit(0))
    total = F.sum(positive).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("_total", total).withColumn(out, F.when(F.col("_total") > 0, positive / (F.col("_total") * F.lit(width))).otherwise(F.lit(0.0))).drop("_total")


def shares(cells: DataFrame, count: str, out: str) -> DataFrame:
    """Adds a cell's part of all counts, also below zero; zeros where they add up to nothing. Rows are as many as the grid has cells."""
    total = F.sum(count).over(Window.partitionBy(F.lit(0)))
    return cells.withColumn("_total", total).withColumn(out, F.when(F.col("_total") > 0, F.col(count) / F.col("_total")).otherwise(F.lit(0.0))).drop("_total")


def facets(matched: DataFrame, axis: Axis, score: str = "score", charge: str = "charge") -> DataFrame:
    """(charge, bin, count) of matched peaks with a charge."""
    rows = matched.where(F.col(charge).isNotNull() & finite(F.col(score).cast("double")))
    return rows.select(F.col(charge).alias("charge"), axis.bin(F.col(score)).alias("bin")).where("bin IS NOT NULL").groupBy("charge", "bin").agg(F.count(F.lit(1)).alias("count"))


def cuts_at_or_below(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are at or below ``value``, by halving: about the logarithm of their number in steps."""
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    sorted_ = F.array(*map(F.lit, cuts))
    # beyond the end get() is null, which is no step forward
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(sorted_, at + step - 1) <= value, at + step).otherwise(at))


def quantiles(rows: DataFrame, value: str, levels: list[float], per_task: int = 1_000_000) -> list[float | None]:
    """Exact quantiles of a column, linear between neighbours; None without values. Nulls do not count.

    Approximate quantiles cut the values into ranges of about ``per_task``. Counts of the ranges, at most 1,000 rows, say
    which of them hold the neighbours that are asked for; within those, running counts of distinct values find them. So no
    task holds more than the distinct values of a range. Counts of distinct values are kept while this runs, for four passes.
    """
    counts = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        if not total:
            return [None] * len(levels)
        places = [min(1.0, x) * (total - 1) for x in levels]
        wanted = sorted({k for p in places for k in (int(p), min(total - 1, int(p) + 1))})
        parts = min(1000, -(-total // per_task))
        cuts = sorted(set(counts.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 20 * parts)).first()[0])) if parts > 1 else []
        part = F.lit(0)
        if cuts:
            part = cuts_at_or_below(F.col("v"), cuts)
        ranged = counts.withColumn("part", part)
        sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
        starts, before = {}, 0
        for k in sorted(sizes):
            starts[k], before = before, before + sizes[k]
        held = [k for k in starts if any(starts[k] <= w < starts[k] + sizes[k] for w in wanted)]
        start = F.element_at(F.create_map(*[F.lit(x) for k in held for x in (k, starts[k])]), F.col("part"))
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
        placed = ranged.where(F.col("part").isin(held)).withColumn("upto", start + upto)
        hit = F.filter(F.array(*map(F.lit, wanted)), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n")))
        at = {r["w"]: r["v"] for r in placed.select("v", F.explode(hit).alias("w")).collect()}  # two values for each level at most
        low = [at[int(p)] for p in places]
        high = [at[min(total - 1, int(p) + 1)] for p in places]
        return [a if a == b else (int(p) + 1 - p) * a + (p - int(p)) * b for p, a, b in zip(places, low, high, strict=True)]
    finally:
        counts.unpersist()


def intensity_quantile(peaks: DataFrame, level: float = 0.3, score: str = "score", intensity: str = "intensity") -> float | None:
    """The quantile of the log-intensity of finite peaks, linear between neighbours; None without any."""
    return quantiles(passing(peaks, None, score, intensity).select(log_intensity(F.col(intensity)).alias("value")), "value", [level])[0]


def smoothed(cells: DataFrame, axis_y: Axis, axis_x: Axis, count: str = "count", sigma: float = 2.0, reach: int = 8) -> DataFrame:
    """Gaussian smoothing of a grid, one axis after the other; beyond its edges the grid is mirrored. (log_bin, score_bin, smooth)."""
    import math

    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    weights = [w / sum(weights) for w in weights]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True)])
    rows = cells.select("log_bin", "score_bin", F.col(count).cast("double").alias("smooth"))
    for key, other, n in (("log_bin", "score_bin", axis_y.bins), ("score_bin", "log_bin", axis_x.bins)):
        spread = rows.select(key, other, "smooth", F.explode(kernel).alias("k"))
        to = F.pmod(F.col(key) + F.col("k.d"), F.lit(2 * n))
        spread = spread.withColumn("_to", F.when(to >= n, 2 * n - 1 - to).otherwise(to))
        rows = spread.groupBy(F.col("_to").alias(key), other).agg(F.sum(F.col("smooth") * F.col("k.w")).alias("smooth"))
    return rows.select("log_bin", "score_bin", "smooth")


def draws(cells: DataFrame, place: str = "bin", weight: str = "count", n: int = 200_000, seed: int = 0, out: str = "draws") -> DataFrame:
    """``cells`` with how often each is drawn in ``n`` draws in proportion to whole weights: systematic sampling, the same in each run.

    Draw k falls on the unit (k * total + offset) / n of all units of weight in the order of ``place``, a whole number that tells
    cells apart; the offset comes from the seed. So each cell is drawn within one of its expectation. Null and negative
    weights count as 0, and without any weight there are no draws. Running sums go over buckets of places and inside them.
    """
    unit = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("decimal(38,0)")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cells.withColumns({"_w": unit, "_bucket": F.floor(F.col(place) / F.lit(4096))})
    sums = rows.groupBy("_bucket").agg(F.sum("_w").alias("_w"))
    starts = sums.select("_bucket", before(Window.orderBy("_bucket"), "_w").alias("_start"))  # one row for 4,096 places
    total = cells.agg(F.coalesce(F.sum(unit), F.lit(0)).alias("_total"))  # one row
    inside = rows.withColumn("_in", before(Window.partitionBy("_bucket").orderBy(place), "_w"))
    low = F.col("_start") + F.col("_in")
    offset = F.lit(seed * 2_654_435_761 + 1_013_904_223).cast("decimal(38,0)") % F.col("_total")
    # draws below a unit: the least k with k * total + offset >= unit * n
    upto = lambda c: F.ceil(((c * n).cast("decimal(38,0)") - offset) / F.col("_total"))
    found = inside.join(F.broadcast(starts), "_bucket").crossJoin(total)
    number = F.when(F.col("_total") > 0, upto(low + F.col("_w")) - upto(low)).otherwise(0).cast("long")
    return found.select(*cells.columns, number.alias(out))


def drop_message(what: str, before: int, after: int) -> str | None:
    """A line about dropped rows; None where all stayed."""
    return None if before == after else f"{what}: {before - after} of {before} dropped, {after} left"


def plot_label(method: str, params: str, threshold: float | None = None, width: int = 80) -> str:
    """A label of method and parameters, in lines of ``width``, with the slice's threshold to three places."""
    text = " | ".join(x for x in (method, params, None if threshold is None else f"log10(1 + intensity) >= {threshold:.3f}") if x)
    return "\n".join(textwrap.wrap(text, width))


@dataclass
class Slice:
    """The plot data of one slice of the peaks; ``notes`` tell of dropped rows."""

    name: str
    threshold: float | None
    score_axis: Axis
    log_axis: Axis
    cells: DataFrame
    contours: DataFrame
    scores: DataFrame
    by_charge: DataFrame
    notes: list[str]


def slice_data(name: str, library: DataFrame, matched: DataFrame, threshold: float | None = None) -> Slice | None:
    """All and matched counts by cell with shares, the shares smoothed, counts by score with densities, and by charge.

    None where no peak is finite or none is matched.
    """
    found = axes(library, threshold)
    good = passes(threshold) & F.col("charge").isNotNull()
    rows, kept = matched.agg(F.count(F.lit(1)), F.count_if(good)).first()
    if found is None or not kept:
        return None
    score, log = found
    matched_good = matched.where(good)
    cells = unmatched(histogram_2d(library, score, log, threshold), histogram_2d(matched_good, score, log, threshold), ["log_bin", "score_bin"])
    counts = marginal(cells, "score_bin", "all_count", "matched_count", "unmatched_count")
    for count in ("all_count", "matched_count", "unmatched_count"):
        counts = density(counts, count, score.width, count.replace("count", "density"))
    for part in ("matched", "unmatched"):
        cells = shares(cells, f"{part}_count", f"{part}_share")
    smooth = [smoothed(cells, log, score, f"{part}_share").withColumnRenamed("smooth", part) for part in ("matched", "unmatched")]
    contours = smooth[0].join(smooth[1], ["log_bin", "score_bin"], "full")
    facet = Axis(score.low, score.high, BINS_FACET, score.n)
    notes = [drop_message(f"{name}, matched", rows, kept), drop_message(f"{name}, all", score.total, score.n)]
    return Slice(name, threshold, score, log, cells, contours, counts, facets(matched_good, facet), [x for x in notes if x])


def compare_scores(library: DataFrame, mapping: DataFrame, mapped: DataFrame, level: float = 0.3, distinct: bool = False) -> list[Slice]:
    """Slices "all" and "q30"; empty without finite or matched peaks.

    The second holds the peaks from the quantile of the matched ones' intensity on. Matched peaks are written once.
    """
    matched = saved(matched_peaks(library, mapping, mapped, distinct))
    out = [slice_data("all", library, matched)]
    threshold = intensity_quantile(matched, level)
    if threshold is not None:
        out.append(slice_data("q30", library, matched, threshold))
    return [s for s in out if s is not None]
