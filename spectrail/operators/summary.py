"""Counts of search results at a false-discovery rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrail.functions.scalars import at_most

LEVELS = {"psm": "spectrum_q", "peptide": "peptide_q", "protein": "protein_q"}
COUNTS = ("psm_count", "peptide_count", "ion_count", "protein_count")


def fdr_filter(psms: DataFrame, fdr: float = 0.01, level: str = "peptide") -> DataFrame:
    """Rows whose q-value of the level is at most ``fdr``; null and NaN fail. An unknown level is a KeyError."""
    q = LEVELS[level]
    return psms.where(at_most(F.col(q), fdr, dict(psms.dtypes)[q]))


def protein_names(psms: DataFrame, *keys: Column) -> DataFrame:
    """A row for each name in the ;-separated proteins, without outer blanks; empty names stay, null lists give none."""
    return psms.select(*keys, F.explode(F.split("proteins", ";")).alias("protein")).withColumn("protein", F.trim("protein"))


def count_all(psms: DataFrame, by: str | None = None) -> DataFrame:
    """PSMs, distinct peptides, ions (peptide with charge; nulls are values) and proteins; one row, or one for each ``by``.

    Two scans: the exploded proteins have a branch of their own, so that they do not multiply the other counts.
    """
    keys = [F.col(by)] if by else []
    first = [F.count(F.lit(1)).alias("psm_count"), F.count_distinct("peptide").alias("peptide_count"), F.count_distinct(F.struct("peptide", "charge")).alias("ion_count")]
    second = F.count_distinct("protein").alias("protein_count")
    if not by:
        return psms.agg(*first).crossJoin(protein_names(psms).agg(second))  # one row each
    main, proteins = psms.groupBy(by).agg(*first), protein_names(psms, *keys).groupBy(by).agg(second)
    other = proteins.withColumnRenamed(by, "_by")
    joined = main.join(other, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, *COUNTS[:3], F.coalesce("protein_count", F.lit(0)).alias("protein_count"))


def summarize(psms: DataFrame, fdr: float = 0.01, level: str = "peptide", by: str | None = None) -> DataFrame:
    """The four counts of what passes the filter."""
    return count_all(fdr_filter(psms, fdr, level), by)


def compare(psms: DataFrame, fdr: float = 0.01, level: str = "peptide", label: str = "label") -> DataFrame:
    """The four counts for each label, those with most of the level's units first; labels settle ties.

    A label without any passing row has zeros.
    """
    every = psms.select(label).distinct().withColumnRenamed(label, "_label")
    counts = summarize(psms, fdr, level, label)
    joined = every.join(counts, F.col("_label").eqNullSafe(F.col(label)), "left")
    rows = joined.select(F.col("_label").alias(label), *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))
    return rows.orderBy(F.desc(f"{level}_count"), label)
