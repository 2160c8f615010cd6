"""Scans over spectra in text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(spectrum): the text of each spectrum that ends; what follows the last end is none."""
    text = spark.read.option("lineSep", "END IONS\n").text(path)
    return text.where(F.contains("value", F.lit("BEGIN IONS"))).select(F.col("value").alias("spectrum"))


def max_peak(spectrum: Column) -> Column:
    """The largest first number among the lines of two numbers behind the last title."""
    tail = F.regexp_replace(spectrum, r"(?s)^.*\nTITLE=[^\n]*", "")
    found = F.regexp_extract_all(tail, F.lit(rf"(?m)^[ \t]*({_NUMBER})[ \t]+{_NUMBER}[ \t]*\r?$"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("double")))


def max_fragment_mz(spectra: DataFrame, cutoff: float | None = None) -> DataFrame:
    """(title, max_mz) of each spectrum with a peak; with a cutoff, only of those above it."""
    title = F.regexp_extract("spectrum", r"(?m)^TITLE=([^\r\n]*)", 1)
    rows = spectra.select(title.alias("title"), max_peak(F.col("spectrum")).alias("max_mz")).where("max_mz IS NOT NULL")
    return rows if cutoff is None else rows.where(F.col("max_mz") > cutoff)


def largest(rows: DataFrame) -> DataFrame:
    """The title with the largest peak, the first by title where several have it, and that peak."""
    best = rows.agg(F.min(F.struct((-F.col("max_mz")).alias("m"), "title")).alias("b"))
    return best.where("b IS NOT NULL").select(F.col("b.title").alias("title"), (-F.col("b.m")).alias("max_mz"))
