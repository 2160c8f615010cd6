"""The operators' tables, derived from the given ones by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PSMS = (
    "o_orderkey AS psm_id",
    "concat('PEP', o_custkey % 400) AS peptide",
    "cast(2 + o_orderkey % 3 AS int) AS charge",
    "concat('P', o_custkey % 90, '; P', o_orderkey % 120) AS proteins",
    "concat('precursor_idx=', o_custkey, ' charge=', 2 + o_orderkey % 3) AS scannr",
    "(o_orderkey % 200) / 4000.0e0 AS spectrum_q",
    "(o_custkey % 50) / 2000.0e0 AS peptide_q",
    "(o_orderkey % 31) / 1500.0e0 AS protein_q",
    "600.0e0 + (o_custkey * 13) % 3000 AS expmass",
    "((o_custkey % 41) - 20) / 2.0e0 AS precursor_ppm",
    "((o_orderkey % 61) - 30) / 3.0e0 AS fragment_ppm",
)
LIBRARY = (
    "p_partkey AS fragment_idx",
    "cast(200.0e0 + 7 * (p_partkey % 20) + 0.1e0 * (cast(floor(p_partkey / 20.0e0) AS bigint) % 50) AS float) AS mz",
    "CASE WHEN p_partkey % 17 = 0 THEN cast('NaN' AS double) ELSE cast(p_size AS double) END AS score",
    "(p_partkey * 37) % 65521 AS intensity",
)
PRECURSORS = ("c_custkey AS precursor_idx", "20 * ((c_custkey * 7) % slices) AS fragment_spectrum_start", "cast(20 AS bigint) AS fragment_event_cnt", "cast(234 AS bigint) AS charges")
FRAGMENTS = (
    "event_id AS sage_fragment_idx",
    "o_orderkey AS psm_id",
    "cast(200.0e0 + 7 * ((event_id * 7) % 20) + 0.1e0 * (cast(floor(fragment_spectrum_start / 20.0e0) AS bigint) % 50) + ((event_id % 9) - 4) * 0.0003e0 AS float) AS fragment_mz_experimental",
)
OWNER = "1 + 4 * (event_id % greatest(cast(floor(psms / 4.0e0) AS bigint), 1))"
RUNS = (
    "o_orderkey AS id",
    "'p' AS pipeline_path",
    "'2024-01-01' AS run_date",
    "o_orderstatus AS search_engine",
    "concat('D', o_custkey % 20) AS dataset",
    "o_orderpriority AS cfg",
    "cast(floor(o_totalprice) AS bigint) AS peptide_count",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS status",
)
LOG = "concat('after FDR filtering: psms=', o_orderkey, ' peptides=', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN concat(' proteins=', o_orderkey % 7) ELSE '' END) AS line"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*PSMS)


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*LIBRARY)


def precursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = table(spark, sf_dir, "part").agg(F.floor(F.count(F.lit(1)) / 20).alias("slices"))  # one row
    return table(spark, sf_dir, "customer").crossJoin(slices).selectExpr(*PRECURSORS)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a fragment; every fourth PSM, over all of them, has fragments, most of them several."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    size = orders.agg(F.count(F.lit(1)).alias("psms"))  # one row
    starts = precursors(spark, sf_dir).select("precursor_idx", "fragment_spectrum_start")
    events = table(spark, sf_dir, "events").select("event_id")
    owned = events.crossJoin(size).withColumn("own", F.expr(OWNER))
    joined = owned.join(orders, F.expr("own = o_orderkey")).join(starts, F.expr("o_custkey = precursor_idx"))
    return joined.selectExpr(*FRAGMENTS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*RUNS)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", LOG)


#: The same as common table expressions.
SQL = f"""
psms AS (SELECT {', '.join(PSMS)} FROM orders),
library AS (SELECT {', '.join(LIBRARY)} FROM part),
precursors AS (SELECT {', '.join(PRECURSORS)} FROM customer, (SELECT cast(floor(count(*) / 20.0e0) AS bigint) AS slices FROM part)),
fragments AS (SELECT {', '.join(FRAGMENTS)} FROM (SELECT event_id, {OWNER} AS own FROM events, (SELECT count(*) AS psms FROM orders)) JOIN orders ON own = o_orderkey JOIN precursors ON o_custkey = precursor_idx),
runs AS (SELECT {', '.join(RUNS)} FROM orders)
"""
