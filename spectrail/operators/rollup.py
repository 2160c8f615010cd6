"""Exact counts of distinct values that merge: files are counted once, and any set of them by the union of their bitmaps.

A dictionary gives each peptide, ion (peptide with charge) and protein name a dense code. A file's part of the table is then a
bitmap for each kind and stretch of 32,768 codes, and counts of several files are the set bits of the bitmaps' union, without
the rows. Dictionaries grow: what new files bring gets codes behind those that are given, so older bitmaps stay right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrail.operators.summary import COUNTS, protein_names
from spectrail.sources.shared import saved

#: Kinds of keys, with the counts that they make.
KINDS = {"peptide": "peptide_count", "ion": "ion_count", "protein": "protein_count"}
#: Distinct keys that one task numbers.
PER_BUCKET = 200_000


def _ions(psms: DataFrame, by: Column) -> DataFrame:
    """(by, peptide, charge, n): the rows of each ion. What follows works on ions and proteins, not on rows."""
    return psms.groupBy(by.alias("by"), "peptide", "charge").agg(F.count(F.lit(1)).alias("n"))


def keys(psms: DataFrame, by: Column) -> DataFrame:
    """(by, kind, name, charge, n) once for each key: ions count null parts as values, peptides don't; n is an ion's rows."""
    ions = saved(_ions(psms, by))
    peptides = ions.where("peptide IS NOT NULL").select("by", "peptide").distinct()
    proteins = protein_names(psms, by.alias("by")).where("protein IS NOT NULL").distinct()
    row = lambda df, kind, name, charge, n: df.select("by", F.lit(kind).alias("kind"), name.alias("name"), charge.cast("int").alias("charge"), n.cast("long").alias("n"))
    return row(ions, "ion", F.col("peptide"), F.col("charge"), F.col("n")).unionByName(row(peptides, "peptide", F.col("peptide"), F.lit(None), F.lit(0))).unionByName(row(proteins, "protein", F.col("protein"), F.lit(None), F.lit(0)))


_SAME = ("kind", "name", "charge")


def _match(a: DataFrame, b: DataFrame) -> Column:
    return (a["kind"] == b["kind"]) & a["name"].eqNullSafe(b["name"]) & a["charge"].eqNullSafe(b["charge"])


def dictionary(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(kind, name, charge, code): dense codes from 0 for each kind's keys; those of ``known`` stay, new ones follow.

    Buckets by hash number their own keys, and sums over the buckets, one row for each, put them behind each other.
    """
    new = found.select(*_SAME).distinct()
    if known is not None:
        new = new.join(known, _match(new, known), "left_anti")
    new = saved(new)
    buckets = max(1, -(-new.count() // PER_BUCKET))
    placed = new.withColumn("_b", F.pmod(F.xxhash64(*_SAME), F.lit(buckets)))
    inside = placed.withColumn("_i", F.row_number().over(Window.partitionBy("kind", "_b").orderBy("name", "charge")) - 1)
    before = Window.partitionBy("kind").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("kind", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    coded = inside.join(starts, ["kind", "_b"]).select(*_SAME, (F.col("_s") + F.col("_i")).cast("long").alias("code"))
    if known is None:
        return coded
    ends = known.groupBy("kind").agg((F.max("code") + 1).alias("_end"))  # one row for each kind
    coded = coded.join(F.broadcast(ends), "kind", "left").withColumn("code", F.col("code") + F.coalesce("_end", F.lit(0))).drop("_end")
    return known.select(*_SAME, "code").unionByName(coded)


def bitmaps(found: DataFrame, codes: DataFrame) -> DataFrame:
    """(by, kind, bucket, bits, n): bitmaps of codes for each ``by`` and kind; n sums the rows of a bitmap's ions."""
    coded = found.join(codes, _match(found, codes)).select(found["by"], found["kind"], found["n"], codes["code"])
    bucket = F.bitmap_bucket_number("code").alias("bucket")
    return coded.groupBy("by", "kind", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"), F.sum("n").alias("n"))


def merged_counts(bits: DataFrame, by: str | None = None) -> DataFrame:
    """The four counts over the union of all bitmaps, one row, or one for each value of ``by``, a column of ``bits``."""
    own = [by] if by else []
    united = bits.groupBy(*own, "kind", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))
    size = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.bitmap_count("bits"))), F.lit(0)).cast("long")
    counts = {"psm_count": F.coalesce(F.sum("n"), F.lit(0)).cast("long")} | {name: size(kind) for kind, name in KINDS.items()}
    return united.groupBy(*own).agg(*[counts[c].alias(c) for c in COUNTS])
