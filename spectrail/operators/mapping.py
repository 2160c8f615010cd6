"""Matched fragments back to the library peaks of their precursors.

A fragment belongs to a PSM, the PSM's scan names a precursor, and a precursor owns a slice of the library. Within the slice
the peak with the nearest m/z counts if it lies within the tolerance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrail.functions.scalars import digits_within, packed_digits, scan_number
from spectrail.operators.distribution import quantiles
from spectrail.operators.nearest import nearest_sorted
from spectrail.sources.shared import saved


class IntegrityError(ValueError):
    """Inputs that contradict each other."""


def scan_keys(psms: DataFrame) -> DataFrame:
    """psm_id, precursor_idx and charge, the latter two from the scan's description."""
    return psms.select("psm_id", scan_number(F.col("scannr"), "precursor_idx").alias("precursor_idx"), scan_number(F.col("scannr"), "charge", "int").alias("charge"))


def resolve(fragments: DataFrame, psms: DataFrame, precursors: DataFrame) -> DataFrame:
    """Fragments of the given PSMs with their precursor's columns; null where no precursor with peaks has that number.

    Rows are known by (sage_fragment_idx, psm_id), which is unique where psm_id is unique among the PSMs.
    """
    slices = precursors.where("fragment_event_cnt > 0").select("precursor_idx", "fragment_spectrum_start", "fragment_event_cnt", F.col("charges").alias("submitted_charges"))
    return fragments.join(scan_keys(psms), "psm_id").join(slices, "precursor_idx", "left")


def unsubmitted(merged: DataFrame) -> DataFrame:
    """Numbers of precursors that fragments name and the precursor table lacks, or has without peaks."""
    return merged.where(F.col("submitted_charges").isNull()).select("precursor_idx").distinct()


def precursor_groups(merged: DataFrame) -> DataFrame:
    """For each precursor: its fragments, slice, submitted charges and the charges that PSMs found, packed as digits."""
    return merged.groupBy("precursor_idx").agg(
        F.count(F.lit(1)).alias("fragment_cnt"),
        F.first("submitted_charges").alias("submitted_charges"),
        F.first("fragment_spectrum_start").alias("fragment_spectrum_start"),
        F.first("fragment_event_cnt").alias("fragment_event_cnt"),
        packed_digits(F.col("charge")).alias("detected_charges"),
    )


def foreign_charges(groups: DataFrame) -> DataFrame:
    """Precursors with a detected charge that was not submitted."""
    return groups.where(~digits_within(F.col("detected_charges"), F.col("submitted_charges")))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(key)


def first_of(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The ``n`` least keys, in order."""
    return rows.select(key).orderBy(key).limit(n)


#: What ``violations`` looks for, by number.
CHECKS = ("psm_id that repeats", "precursor_idx that repeats", "precursor without submitted peaks", "precursor with charges that were not submitted", "precursor whose slice reaches beyond the library")


def violations(psms: DataFrame, precursors: DataFrame, merged: DataFrame, groups: DataFrame, library: DataFrame | None = None, n: int = 20) -> DataFrame:
    """(check, total, key): for each check of ``CHECKS`` that fails, how many keys do, and the ``n`` least of them, a row each.

    One plan for all checks: the offenders are united, counted, and cut to the least keys before they are dealt out. The
    library is only looked at where it is given.
    """
    parts = [repeated(psms, "psm_id"), repeated(precursors, "precursor_idx"), unsubmitted(merged), foreign_charges(groups.where("submitted_charges IS NOT NULL")).select("precursor_idx")]
    if library is not None:
        parts.append(missing_peaks(precursors, library).select("precursor_idx").distinct())
    rows = None
    for i, part in enumerate(parts):
        own = part.select(F.lit(i).alias("check"), F.col(part.columns[0]).cast("long").alias("key"))
        rows = own if rows is None else rows.unionByName(own)
    counts = rows.groupBy(F.col("check").alias("_check")).agg(F.count(F.lit(1)).alias("total"))  # one row for each check
    least = rows.withColumn("_n", F.row_number().over(Window.partitionBy("check").orderBy("key"))).where(F.col("_n") <= n)
    return least.join(F.broadcast(counts), F.col("check") == F.col("_check")).select("check", "total", "key")


def validate(psms: DataFrame, precursors: DataFrame, merged: DataFrame, groups: DataFrame, library: DataFrame | None = None) -> None:
    """Raises IntegrityError for the first check that fails, with the number of offenders and the first of them."""
    found = violations(psms, precursors, merged, groups, library).collect()  # 20 rows for each check at most
    if found:
        first = min(r["check"] for r in found)
        own = sorted((r for r in found if r["check"] == first), key=lambda r: (r["key"] is not None, r["key"]))
        raise IntegrityError(f"{own[0]['total']} x {CHECKS[first]}; the first: {[r['key'] for r in own]}")


def slice_peaks(precursors: DataFrame, library: DataFrame, compat_stall: bool = False) -> DataFrame:
    """(precursor_idx, fragment_idx, mz) of each precursor's library slice.

    With ``compat_stall``, a slice ends behind the first of two neighbours with the same m/z.
    """
    wanted = precursors.where("fragment_event_cnt > 0").select("precursor_idx", F.explode(F.sequence("fragment_spectrum_start", F.col("fragment_spectrum_start") + F.col("fragment_event_cnt") - 1)).alias("fragment_idx"))
    peaks = wanted.join(library.select("fragment_idx", "mz"), "fragment_idx").select("precursor_idx", "fragment_idx", "mz")
    if not compat_stall:
        return peaks
    by = Window.partitionBy("precursor_idx").orderBy("fragment_idx")
    stalls = peaks.withColumn("_stall", F.lead("mz").over(by) == F.col("mz"))
    cut = F.min(F.when(F.col("_stall"), F.col("fragment_idx"))).over(Window.partitionBy("precursor_idx"))
    return stalls.withColumn("_cut", cut).where("_cut IS NULL OR fragment_idx <= _cut").drop("_stall", "_cut")


def missing_peaks(precursors: DataFrame, library: DataFrame) -> DataFrame:
    """Places of slices that the library does not have."""
    wanted = precursors.where("fragment_event_cnt > 0").select("precursor_idx", F.explode(F.sequence("fragment_spectrum_start", F.col("fragment_spectrum_start") + F.col("fragment_event_cnt") - 1)).alias("fragment_idx"))
    return wanted.join(library, "fragment_idx", "left_anti")


#: The widest tolerance for which peaks are met by buckets.
NARROW = 0.05


def nearest(merged: DataFrame, precursors: DataFrame, library: DataFrame, tolerance: float = 0.001, compat_stall: bool = False, sort: bool | None = None) -> DataFrame:
    """(precursor_idx, sage_fragment_idx, psm_id, pmsms_fragment_idx, mz_delta) of fragments with a peak within the tolerance.

    The nearest peak counts, of two equally near ones that with the lower m/z, then the first. Distances are compared in
    single precision, like the m/z themselves. Two ways with one result: with a narrow tolerance, buckets of twice its width
    make this an equi-join, since a peak lies in the fragment's bucket or in one beside it; a wide one would list too many
    pairs, so both sides are sorted (``nearest_sorted``), at the price of writing them once. ``sort`` asks for either way.
    """
    own = precursors.join(merged.select("precursor_idx").distinct(), "precursor_idx", "left_semi")  # slices that no fragment needs stay unread
    peaks = slice_peaks(own, library, compat_stall).withColumnRenamed("mz", "lib_mz")
    queries = merged.where(F.col("submitted_charges").isNotNull()).select("precursor_idx", "sage_fragment_idx", "psm_id", F.col("fragment_mz_experimental").cast("float").alias("exp_mz"))
    delta = F.col("lib_mz") - F.col("exp_mz")
    limit = F.lit(tolerance).cast("float")
    if tolerance > NARROW if sort is None else sort:
        found = nearest_sorted(queries, peaks, "precursor_idx", "exp_mz", "lib_mz", "fragment_idx").where(F.col("near.distance") <= limit)
        return found.select("precursor_idx", "sage_fragment_idx", "psm_id", F.col("near.place").alias("pmsms_fragment_idx"), F.col("near.delta").alias("mz_delta"))
    if tolerance < 0:
        joined = queries.join(peaks, "precursor_idx").where(F.lit(False))
    elif tolerance == 0:
        joined = queries.withColumn("same_mz", F.col("exp_mz")).join(peaks.withColumn("same_mz", F.col("lib_mz")), ["precursor_idx", "same_mz"])
    else:
        bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(2.0 * tolerance))
        near = queries.withColumn("bucket", F.explode(F.array(bucket("exp_mz") - 1, bucket("exp_mz"), bucket("exp_mz") + 1)))
        joined = near.join(peaks.withColumn("bucket", bucket("lib_mz")), ["precursor_idx", "bucket"]).where(F.abs(delta) <= limit)
    best = F.min(F.struct(F.abs(delta).alias("distance"), "lib_mz", "fragment_idx", delta.alias("mz_delta"))).alias("best")
    found = joined.groupBy("precursor_idx", "sage_fragment_idx", "psm_id").agg(best)
    return found.select("precursor_idx", "sage_fragment_idx", "psm_id", F.col("best.fragment_idx").alias("pmsms_fragment_idx"), F.col("best.mz_delta").alias("mz_delta"))


#: Numbers of precursors that share a bucket of the running sum.
BUCKET = 65_536


def mapped_counts(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """The precursors that have hits: charges, and place and number of their rows in the mapping.

    The running sum goes over buckets of precursor numbers first and over the precursors of each bucket then, so only the
    sums of buckets meet in one task.
    """
    bucket = F.floor(F.col("precursor_idx") / F.lit(BUCKET)).alias("_bucket")
    counts = hits.groupBy("precursor_idx").agg(F.count(F.lit(1)).alias("mapped_cnt")).select("*", bucket)
    before = lambda w: F.coalesce(F.sum("mapped_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy("_bucket").agg(F.sum("mapped_cnt").alias("mapped_cnt"))
    starts = sums.select("_bucket", before(Window.orderBy("_bucket")).alias("_start"))
    inside = counts.withColumn("_inside", before(Window.partitionBy("_bucket").orderBy("precursor_idx")))
    placed = inside.join(starts, "_bucket").withColumn("mapped_idx", F.col("_start") + F.col("_inside"))
    return placed.join(groups, "precursor_idx").select("precursor_idx", "detected_charges", "submitted_charges", "mapped_idx", "mapped_cnt")


def mapping_rows(hits: DataFrame, mapped: DataFrame) -> DataFrame:
    """Hits in the mapping's order: by precursor, then by fragment; mapping_row is their place."""
    inside = F.row_number().over(Window.partitionBy("precursor_idx").orderBy("sage_fragment_idx", "psm_id")) - 1
    rows = hits.withColumn("_place", inside).join(mapped.select("precursor_idx", "mapped_idx"), "precursor_idx")
    return rows.select("pmsms_fragment_idx", "sage_fragment_idx", (F.col("mapped_idx") + F.col("_place")).alias("mapping_row"), "precursor_idx")


def delta_quantiles(hits: DataFrame) -> DataFrame:
    """101 rows: quantiles 0, 0.01 .. 1 of the signed m/z differences, linear between neighbours; null without hits."""
    found = quantiles(hits, "mz_delta", [i * 0.01 for i in range(101)])
    return hits.sparkSession.createDataFrame([(i * 0.01, x) for i, x in enumerate(found)], "quantile double, mz_delta double").withColumn("mz_delta", F.col("mz_delta").cast("float"))


def match_metrics(merged: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: fragments, those of a known precursor, those matched, and the latter's share of all in percent (null of none)."""
    found = hits.select("sage_fragment_idx", "psm_id", F.lit(1).alias("_hit"))
    joined = merged.join(found, ["sage_fragment_idx", "psm_id"], "left")
    counts = joined.agg(F.count(F.lit(1)).alias("fragments"), F.count_if(F.col("submitted_charges").isNotNull()).alias("resolved"), F.count("_hit").alias("matched"))
    return counts.withColumn("matched_percent", F.when(F.col("fragments") > 0, 100.0 * F.col("matched") / F.col("fragments")))


@dataclass
class MappingTables:
    mapping: DataFrame
    precursors: DataFrame
    mz_delta_quantiles: DataFrame


def map_fragments(psms: DataFrame, fragments: DataFrame, precursors: DataFrame, library: DataFrame, tolerance: float = 0.001, compat_stall: bool = False, check: bool = True) -> MappingTables:
    """The whole chain: resolve, validate, match, and the three tables. What they share is written once, in the shared folder."""
    merged = saved(resolve(fragments, psms, precursors))
    groups = precursor_groups(merged)
    if check:
        validate(psms, precursors, merged, groups, library)
    hits = saved(nearest(merged, precursors, library, tolerance, compat_stall))
    mapped = mapped_counts(hits, groups)
    return MappingTables(mapping_rows(hits, mapped), mapped, delta_quantiles(hits))
