"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail import schemas
from spectrail.functions.scalars import digits_within, log_intensity
from spectrail.operators import calibration, distribution, mapping, registry, rollup, spectra, summary
from spectrail.plans import fixtures as fx
from spectrail.sources import columns, tables
from spectrail.sources.shared import new_path, saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FDR, TOLERANCE = 0.01, 0.001


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL over the derived tables."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = f"WITH {fx.SQL}{sql}"
        return f

    return add


_COUNTS = "count(*) AS psm_count, count(DISTINCT peptide) AS peptide_count, count(DISTINCT (peptide, charge)) AS ion_count"


def _summary_sql(where: str) -> str:
    return f"""SELECT * FROM (SELECT {_COUNTS} FROM psms {where}),
(SELECT count(DISTINCT trim(p)) AS protein_count FROM (SELECT unnest(string_split(proteins, ';')) AS p FROM psms {where}))"""


def _fdr_summary(level: str) -> Query:
    return lambda spark, sf_dir: summary.summarize(fx.psms(spark, sf_dir), FDR, level)


for _level, _q in summary.LEVELS.items():
    query(_summary_sql(f"WHERE {_q} <= 0.01e0"), f"fdr_summary_{_level}")(_fdr_summary(_level))


@query("SELECT psm_id, peptide, charge, proteins, peptide_q FROM psms WHERE peptide_q <= 0.01e0")
def fdr_filter_peptide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.fdr_filter(fx.psms(spark, sf_dir), FDR, "peptide").select("psm_id", "peptide", "charge", "proteins", "peptide_q")


@query(_summary_sql(""))
def unfiltered_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.count_all(fx.psms(spark, sf_dir))


@query(
    f"""SELECT label, psm_count, peptide_count, ion_count, protein_count FROM (SELECT concat('file', psm_id % 7) AS label, {_COUNTS} FROM psms WHERE peptide_q <= 0.01e0 GROUP BY 1)
JOIN (SELECT label, count(DISTINCT trim(p)) AS protein_count FROM (SELECT concat('file', psm_id % 7) AS label, unnest(string_split(proteins, ';')) AS p FROM psms WHERE peptide_q <= 0.01e0) GROUP BY 1) USING (label)"""
)
def summary_by_group_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.compare(fx.psms(spark, sf_dir).withColumn("label", F.expr("concat('file', psm_id % 7)")), FDR, "peptide")


def _bitmaps(psms: DataFrame) -> DataFrame:
    """Bitmaps of seven files, of which the last two come later and extend the dictionary."""
    label = F.expr("concat('file', psm_id % 7)")
    first, later = (rollup.keys(summary.fdr_filter(psms, FDR, "peptide").where(w), label) for w in ("psm_id % 7 < 5", "psm_id % 7 >= 5"))
    codes = saved(rollup.dictionary(first))
    more = saved(rollup.dictionary(later, codes))
    return rollup.bitmaps(first, codes).unionByName(rollup.bitmaps(later, more))


@query(_summary_sql("WHERE peptide_q <= 0.01e0"))
def merged_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.merged_counts(_bitmaps(fx.psms(spark, sf_dir)))


@query(ORACLES["summary_by_group_sorted"].removeprefix(f"WITH {fx.SQL}"))
def merged_summary_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.merged_counts(_bitmaps(fx.psms(spark, sf_dir)), "by").withColumnRenamed("by", "label")


_KEYS = "cast(regexp_extract(scannr, 'precursor_idx=(\\d+)', 1) AS bigint) AS precursor_idx, cast(regexp_extract(scannr, 'charge=(\\d+)', 1) AS int) AS charge"


@query(f"SELECT psm_id, {_KEYS} FROM psms")
def scan_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.scan_keys(fx.psms(spark, sf_dir))


@query("SELECT psm_id, trim(p) AS protein FROM (SELECT psm_id, unnest(string_split(proteins, ';')) AS p FROM psms)")
def protein_unnest_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.protein_names(fx.psms(spark, sf_dir), F.col("psm_id"))


_MERGED = f"""
, keyed AS (SELECT psm_id, {_KEYS} FROM psms WHERE peptide_q <= 0.01e0),
merged AS (SELECT f.sage_fragment_idx, f.psm_id, f.fragment_mz_experimental, k.precursor_idx, k.charge, p.fragment_spectrum_start, p.fragment_event_cnt, p.charges AS submitted_charges
  FROM fragments f JOIN keyed k USING (psm_id) LEFT JOIN (SELECT * FROM precursors WHERE fragment_event_cnt > 0) p USING (precursor_idx)),
groups AS (SELECT precursor_idx, count(*) AS fragment_cnt, any_value(submitted_charges) AS submitted_charges, any_value(fragment_spectrum_start) AS fragment_spectrum_start, any_value(fragment_event_cnt) AS fragment_event_cnt,
  cast(array_to_string(list_sort(list(DISTINCT cast(charge AS varchar))), '') AS bigint) AS detected_charges FROM merged GROUP BY precursor_idx),
near AS (SELECT m.precursor_idx, m.sage_fragment_idx, m.psm_id, l.fragment_idx AS pmsms_fragment_idx, l.mz - m.fragment_mz_experimental AS mz_delta,
  row_number() OVER (PARTITION BY m.sage_fragment_idx, m.psm_id ORDER BY abs(l.mz - m.fragment_mz_experimental), l.mz, l.fragment_idx) AS n
  FROM merged m JOIN library l ON l.fragment_idx >= m.fragment_spectrum_start AND l.fragment_idx < m.fragment_spectrum_start + m.fragment_event_cnt),
hits AS (SELECT * EXCLUDE (n) FROM near WHERE n = 1 AND abs(mz_delta) <= cast(0.001 AS float)),
mapped AS (SELECT precursor_idx, detected_charges, submitted_charges, cast(coalesce(sum(mapped_cnt) OVER (ORDER BY precursor_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS mapped_idx, mapped_cnt
  FROM (SELECT precursor_idx, count(*) AS mapped_cnt FROM hits GROUP BY precursor_idx) JOIN groups USING (precursor_idx))
"""


def _merged(spark: SparkSession, sf_dir: str, precursors: DataFrame | None = None) -> DataFrame:
    passing = summary.fdr_filter(fx.psms(spark, sf_dir), FDR, "peptide")
    return mapping.resolve(fx.fragments(spark, sf_dir), passing, fx.precursors(spark, sf_dir) if precursors is None else precursors)


def _hits(spark: SparkSession, sf_dir: str, tolerance: float = TOLERANCE, sort: bool | None = None) -> DataFrame:
    """Hits of fragments that are written once with their precursors, since they also say which slices are read."""
    return mapping.nearest(saved(_merged(spark, sf_dir)), fx.precursors(spark, sf_dir), fx.library(spark, sf_dir), tolerance, sort=sort)


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fragments with their precursors, and their hits, each written once for a query that reads them repeatedly."""
    merged = saved(_merged(spark, sf_dir))
    return merged, saved(mapping.nearest(merged, fx.precursors(spark, sf_dir), fx.library(spark, sf_dir), TOLERANCE))


@query(_MERGED + "SELECT sage_fragment_idx, psm_id, precursor_idx, charge, fragment_spectrum_start, fragment_event_cnt, submitted_charges FROM merged")
def fragment_psm_precursor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("sage_fragment_idx", "psm_id", "precursor_idx", "charge", "fragment_spectrum_start", "fragment_event_cnt", "submitted_charges")


@query(_MERGED + "SELECT DISTINCT precursor_idx FROM merged WHERE precursor_idx % 10 = 3")
def unsubmitted_precursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.unsubmitted(_merged(spark, sf_dir, fx.precursors(spark, sf_dir).where("precursor_idx % 10 <> 3")))


@query(_MERGED + "SELECT * FROM groups")
def charge_digit_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.precursor_groups(_merged(spark, sf_dir))


@query(
    _MERGED
    + """SELECT precursor_idx, detected_charges, submitted, len(list_filter(string_split(cast(detected_charges AS varchar), ''), lambda d: NOT contains(cast(submitted AS varchar), d))) = 0 AS good
FROM (SELECT precursor_idx, detected_charges, CASE WHEN precursor_idx % 2 = 0 THEN 23 ELSE 234 END AS submitted FROM groups)"""
)
def charge_digit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.precursor_groups(_merged(spark, sf_dir)).selectExpr("precursor_idx", "detected_charges", "CASE WHEN precursor_idx % 2 = 0 THEN 23 ELSE 234 END AS submitted")
    return rows.withColumn("good", digits_within(F.col("detected_charges"), F.col("submitted")))


@query(_MERGED + "SELECT precursor_idx, sage_fragment_idx, psm_id, pmsms_fragment_idx, mz_delta FROM hits")
def nearest_fragment_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


def _wide_sql(tolerance: str) -> str:
    return _MERGED + f"SELECT precursor_idx, sage_fragment_idx, psm_id, pmsms_fragment_idx, mz_delta FROM near WHERE n = 1 AND abs(mz_delta) <= cast({tolerance} AS float)"


@query(_wide_sql("10"))
def nearest_wide_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 10.0)


@query(_wide_sql("0.001"))
def nearest_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, sort=True)


@query(_MERGED + "SELECT * FROM mapped")
def mapped_precursor_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, hits = _kept(spark, sf_dir)
    return mapping.mapped_counts(hits, mapping.precursor_groups(merged))


@query(_MERGED + "SELECT pmsms_fragment_idx, sage_fragment_idx, mapped_idx + row_number() OVER (PARTITION BY precursor_idx ORDER BY sage_fragment_idx, psm_id) - 1 AS mapping_row, precursor_idx FROM hits JOIN mapped USING (precursor_idx)")
def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, hits = _kept(spark, sf_dir)
    return mapping.mapping_rows(hits, mapping.mapped_counts(hits, mapping.precursor_groups(merged)))


@query(_MERGED + "SELECT i * 0.01e0 AS quantile, cast(round(quantile_cont(cast(mz_delta AS double), [LEAST(1.0e0, x * 0.01e0) FOR x IN range(101)])[i + 1], 6) AS double) AS mz_delta FROM hits, range(101) r(i) GROUP BY i")
def mz_delta_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.delta_quantiles(_hits(spark, sf_dir)).select("quantile", F.round(F.col("mz_delta").cast("double"), 6).alias("mz_delta"))


_FINITE = "isfinite(score)"
_LOG = "log10(1.0e0 + intensity)"


@query(f"SELECT min(score) AS score_min, max(score) AS score_max, count(*) AS n FROM library WHERE {_FINITE}")
def score_range_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.ranges(fx.library(spark, sf_dir), intensity=None)


@query(f"SELECT min(score) AS score_min, max(score) AS score_max, round(min({_LOG}), 9) AS log_min, round(max({_LOG}), 9) AS log_max, count(*) AS n FROM library WHERE {_FINITE} AND {_LOG} >= 3.0e0")
def score_range_thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distribution.ranges(fx.library(spark, sf_dir), 3.0)
    return rows.select("score_min", "score_max", F.round("log_min", 9).alias("log_min"), F.round("log_max", 9).alias("log_max"), "n")


def _hist_sql(where: str, bins: int) -> str:
    return f"""
, good AS (SELECT score AS x FROM library WHERE {where}),
r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins}.0e0 AS step FROM good),
e AS (SELECT cast(k AS int) AS bin, lo + k * step AS low, CASE WHEN k = {bins - 1} THEN hi ELSE lo + (k + 1) * step END AS high FROM r, range({bins}) t(k))
SELECT bin, low, high, count(x) AS count FROM e LEFT JOIN good ON x >= low AND (x < high OR (bin = {bins - 1} AND x = high)) GROUP BY bin, low, high"""


@query(_hist_sql(_FINITE, 100))
def score_hist_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = fx.library(spark, sf_dir)
    return distribution.histogram(lib, F.col("score"), distribution.score_axis(lib))


@query(_hist_sql(f"{_FINITE} AND {_LOG} >= 3.0e0", 100))
def score_hist_1d_thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = fx.library(spark, sf_dir)
    return distribution.histogram(distribution.passing(lib, 3.0), F.col("score"), distribution.score_axis(lib, 3.0))


_DRAWN = """
, cells AS (SELECT psm_id % 1000 AS bin, count(*) * (psm_id % 1000) AS w FROM psms GROUP BY 1),
c AS (SELECT bin, w, sum(w) OVER (ORDER BY bin) - w AS low, sum(w) OVER () AS total FROM cells), o AS (SELECT *, 1013904223 % total AS o FROM c)
SELECT bin, cast(w AS bigint) AS count, cast((((low + w) * 200000 - o + total - 1) // total) - ((low * 200000 - o + total - 1) // total) AS bigint) AS draws FROM o"""


@query(_DRAWN)
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.psms(spark, sf_dir).groupBy(F.expr("psm_id % 1000").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return distribution.draws(cells.select("bin", (F.col("n") * F.col("bin")).alias("count")))


def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    """The number of edges at or below x, less one; the last edge belongs to the last bin."""
    edges = f"[CASE WHEN k = {bins} THEN {hi} ELSE {lo} + k * (({hi} - {lo}) / {bins}.0e0) END FOR k IN range({bins + 1})]"
    return f"cast(least(len(list_filter({edges}, lambda v: v <= {x})) - 1, {bins - 1}) AS int)"


_GRID = f"""
, good AS (SELECT fragment_idx, score AS x, {_LOG} AS y FROM library WHERE {_FINITE}),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM good),
cells AS (SELECT fragment_idx, {_bin_sql('y', 'y0', 'y1', 200)} AS log_bin, {_bin_sql('x', 'x0', 'x1', 200)} AS score_bin FROM good, r)
"""


@query(_GRID + "SELECT log_bin, score_bin, count(*) AS count FROM cells GROUP BY 1, 2")
def score_intensity_hist_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = fx.library(spark, sf_dir)
    return distribution.histogram_2d(lib, *distribution.axes(lib))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, hits = _kept(spark, sf_dir)
    return saved(distribution.matched_peaks(fx.library(spark, sf_dir), hits, mapping.precursor_groups(merged)))


@query(
    _MERGED
    + _GRID
    + """, a AS (SELECT score_bin, count(*) AS all_count FROM cells GROUP BY 1),
m AS (SELECT score_bin, count(*) AS matched_count FROM hits JOIN cells ON pmsms_fragment_idx = fragment_idx GROUP BY 1),
b AS (SELECT score_bin, coalesce(all_count, 0) AS all_count, coalesce(matched_count, 0) AS matched_count, coalesce(all_count, 0) - coalesce(matched_count, 0) AS unmatched_count FROM a FULL JOIN m USING (score_bin)),
t AS (SELECT sum(all_count) AS ta, sum(matched_count) AS tm, sum(greatest(unmatched_count, 0)) AS tu FROM b), w AS (SELECT (x1 - x0) / 200.0e0 AS width FROM r)
SELECT score_bin, all_count, matched_count, unmatched_count, round(all_count / (ta * width), 9) AS all_density, round(CASE WHEN tm > 0 THEN matched_count / (tm * width) ELSE 0.0e0 END, 9) AS matched_density,
  round(CASE WHEN tu > 0 THEN greatest(unmatched_count, 0) / (tu * width) ELSE 0.0e0 END, 9) AS unmatched_density FROM b, t, w"""
)
def matched_vs_unmatched_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distribution.slice_data("all", fx.library(spark, sf_dir), _matched(spark, sf_dir))
    return found.scores.select("score_bin", "all_count", "matched_count", "unmatched_count", *[F.round(f"{n}_density", 9).alias(f"{n}_density") for n in ("all", "matched", "unmatched")])


@query(_MERGED + _GRID + f"SELECT detected_charges AS charge, {_bin_sql('x', 'x0', 'x1', 50)} AS bin, count(*) AS count FROM hits JOIN good ON pmsms_fragment_idx = fragment_idx JOIN groups USING (precursor_idx), r GROUP BY 1, 2")
def score_density_by_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, _ = distribution.axes(fx.library(spark, sf_dir))
    return distribution.facets(_matched(spark, sf_dir), distribution.Axis(score.low, score.high, distribution.BINS_FACET, score.n))


_T30 = f", t AS (SELECT quantile_cont({_LOG}, 0.3) AS q FROM hits JOIN library ON pmsms_fragment_idx = fragment_idx WHERE {_FINITE})"


@query(_MERGED + _T30 + f" SELECT round(q, 9) AS threshold, count(*) AS n, sum(score) AS score_sum FROM library, t WHERE {_FINITE} AND {_LOG} >= q GROUP BY q")
def intensity_q30_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = fx.library(spark, sf_dir)
    q = distribution.intensity_quantile(_matched(spark, sf_dir))
    return distribution.passing(lib, q).agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum")).select(F.round(F.lit(q), 9).alias("threshold"), "n", "score_sum")


@query(_MERGED + "SELECT mapped_idx + i AS mapping_row, detected_charges AS charge FROM mapped, LATERAL (SELECT unnest(range(mapped_cnt)) AS i)")
def charge_per_mapping_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, hits = _kept(spark, sf_dir)
    return distribution.charge_of_rows(mapping.mapped_counts(hits, mapping.precursor_groups(merged)))


_BEST = "max(peptide_count) OVER (PARTITION BY dataset, cfg, search_engine ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)"


@query(f"SELECT id, peptide_count, {_BEST} AS previous_best FROM runs")
def runs_previous_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.previous_best(fx.runs(spark, sf_dir)).select("id", "peptide_count", "previous_best")


_RUN = "id, status, regression, message"


@query(
    """SELECT r.id, CASE WHEN k.id IS NOT NULL AND r.id <> 7 AND r.status = 'unreviewed' THEN 'bested' ELSE r.status END AS status, 0 AS regression,
CASE WHEN k.id IS NOT NULL AND r.id <> 7 AND r.status = 'unreviewed' THEN 'a better run' END AS message
FROM runs r LEFT JOIN (SELECT * FROM runs WHERE id = 7) k ON r.dataset = k.dataset AND r.cfg = k.cfg AND r.search_engine = k.search_engine"""
)
def runs_mark_bested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.bested(registry.migrated(fx.runs(spark, sf_dir)), 7, "a better run").select("id", "status", "regression", "message")


@query("SELECT id, CASE WHEN id = 4 THEN 'reviewed' ELSE status END AS status, CASE WHEN id = 4 THEN 1 ELSE 0 END AS regression, CASE WHEN id = 4 THEN 'checked' END AS message FROM runs")
def runs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.reviewed(registry.migrated(fx.runs(spark, sf_dir)), 4, 1, "checked").select("id", "status", "regression", "message")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS status, 0 AS regression, CASE WHEN id % 5 = 0 THEN 'known good' END AS message FROM runs")
def runs_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = fx.runs(spark, sf_dir).drop("status").withColumns({"accepted": F.expr("CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END"), "acceptance_reason": F.lit("known good")})
    return registry.migrated(legacy).select("id", "status", "regression", "message")


ORACLES_LINE = f"SELECT o_orderkey AS id, {fx.LOG} FROM orders"


@query(f"SELECT id, {', '.join(f'''try_cast(regexp_extract(line, '{m}=(\\d+)', 1) AS bigint) AS {m}''' for m in tables.METRICS)} FROM ({ORACLES_LINE})")
def log_metrics_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.log_metrics_of(fx.log_lines(spark, sf_dir), "line").select("id", *tables.METRICS)


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.library(spark, sf_dir).selectExpr("cast(floor(fragment_idx / 20.0e0) AS bigint) AS s", "concat(intensity, ' ', fragment_idx) AS line")
    text = lines.groupBy("s").agg(F.collect_list("line").alias("lines"))
    return text.select(F.concat(F.lit("BEGIN IONS\nTITLE=S"), "s", F.lit("\nCHARGE=2+\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("spectrum"))


@query("SELECT concat('S', cast(floor(fragment_idx / 20.0e0) AS bigint)) AS title, cast(max(intensity) AS double) AS max_mz FROM library GROUP BY 1")
def spectra_max_mz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.max_fragment_mz(_spectra(spark, sf_dir))


@query("SELECT min(precursor_ppm) AS precursor_ppm_min, max(precursor_ppm) AS precursor_ppm_max, min(fragment_ppm) AS fragment_ppm_min, max(fragment_ppm) AS fragment_ppm_max FROM psms")
def calibration_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.ppm_ranges(fx.psms(spark, sf_dir))


_SPLINES = """
, r AS (SELECT min(expmass) AS a, max(expmass) AS b FROM psms), t AS (SELECT least(greatest((expmass - a) / ((b - a) / 9), 0.0e0), 9.0e0) AS t, precursor_ppm AS y FROM psms, r),
u AS (SELECT least(floor(t), 8) AS p, t - least(floor(t), 8) AS u, y FROM t),
v AS (SELECT [1.0e0] || [CASE WHEN p = j THEN (1 - u) * (1 - u) / 2 WHEN p = j - 1 THEN (-2 * u * u + 2 * u + 1) / 2 WHEN p = j - 2 THEN u * u / 2 ELSE 0.0e0 END FOR j IN range(10)] || [y] AS v FROM u)
SELECT cast(i AS int) AS i, cast(j AS int) AS j, round(sum(v[i + 1] * v[j + 1]), 3) AS s FROM v, range(12) x(i), range(12) z(j) WHERE i <= j GROUP BY i, j"""


@query(_SPLINES)
def calibration_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    psms = fx.psms(spark, sf_dir)
    r = psms.agg(F.min("expmass").alias("a"), F.max("expmass").alias("b")).first()
    sums = calibration.gram(psms, calibration.Basis(r["a"], r["b"]), F.col("precursor_ppm"), "expmass")
    return spark.createDataFrame([(i, j, float(sums[i, j])) for i in range(12) for j in range(i, 12)], "i int, j int, s double").withColumn("s", F.round("s", 3))


@query()
def calibration_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = calibration.split(fx.psms(spark, sf_dir), key="psm_id")
    found = calibration.spline(train, "precursor_ppm").predict(test)
    inside = found.agg(F.avg(F.col("precursor_ppm").between(F.col("low"), F.col("high")).cast("double")).alias("within_band"))  # one row each
    return calibration.metrics_table(found, "precursor_ppm").crossJoin(inside)


@query()
def calibration_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = calibration.split(fx.psms(spark, sf_dir), key="psm_id")
    each = [calibration.metrics_table(calibration.boosted(train, t).predict(test), t).withColumn("target", F.lit(t)) for t in ("precursor_ppm", "fragment_ppm")]
    return each[0].unionByName(each[1])


@query(f"SELECT fragment_idx, round({_LOG}, 9) AS log_intensity FROM library")
def log_intensity_of_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.library(spark, sf_dir).select("fragment_idx", F.round(log_intensity(F.col("intensity")), 9).alias("log_intensity"))


@query(_MERGED + "SELECT count(*) AS fragments, count(m.submitted_charges) AS resolved, count(h.pmsms_fragment_idx) AS matched, 100.0e0 * count(h.pmsms_fragment_idx) / count(*) AS matched_percent FROM merged m LEFT JOIN hits h USING (sage_fragment_idx, psm_id)")
def match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.match_metrics(*_kept(spark, sf_dir))


_Q30 = f"""{_T30},
good AS (SELECT fragment_idx, score AS x, {_LOG} AS y FROM library, t WHERE {_FINITE} AND {_LOG} >= q),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM good),
cells AS (SELECT fragment_idx, {_bin_sql('y', 'y0', 'y1', 200)} AS log_bin, {_bin_sql('x', 'x0', 'x1', 200)} AS score_bin FROM good, r),
a AS (SELECT score_bin, count(*) AS all_count FROM cells GROUP BY 1),
m AS (SELECT score_bin, count(*) AS matched_count FROM hits JOIN cells ON pmsms_fragment_idx = fragment_idx GROUP BY 1)
SELECT score_bin, coalesce(all_count, 0) AS all_count, coalesce(matched_count, 0) AS matched_count, coalesce(all_count, 0) - coalesce(matched_count, 0) AS unmatched_count FROM a FULL JOIN m USING (score_bin)"""


@query(_MERGED + _Q30)
def q30_score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = _matched(spark, sf_dir)
    found = distribution.slice_data("q30", fx.library(spark, sf_dir), matched, distribution.intensity_quantile(matched))
    return found.scores.select("score_bin", "all_count", "matched_count", "unmatched_count")


def _kernel_sql(sigma: float = 2.0, reach: int = 8) -> str:
    return f"(SELECT d, exp(-0.5e0 * pow(d / {sigma}e0, 2)) / sum(exp(-0.5e0 * pow(d / {sigma}e0, 2))) OVER () AS w FROM range(-{reach}, {reach + 1}) k(d))"


def _mirror_sql(key: str, n: int = 200) -> str:
    to = f"(({key} + d) % {2 * n} + {2 * n}) % {2 * n}"
    return f"CASE WHEN {to} >= {n} THEN {2 * n - 1} - {to} ELSE {to} END"


@query(
    _GRID
    + f""", c AS (SELECT log_bin, score_bin, cast(count(*) AS double) AS v FROM cells GROUP BY 1, 2), k AS (SELECT * FROM {_kernel_sql()}),
s AS (SELECT {_mirror_sql('log_bin')} AS log_bin, score_bin, sum(v * w) AS v FROM c, k GROUP BY 1, 2)
SELECT log_bin, {_mirror_sql('score_bin')} AS score_bin, round(sum(v * w), 8) AS smooth FROM s, k GROUP BY 1, 2"""
)
def smoothed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = fx.library(spark, sf_dir)
    score, log = distribution.axes(lib)
    return distribution.smoothed(distribution.histogram_2d(lib, score, log), log, score).select("log_bin", "score_bin", F.round("smooth", 8).alias("smooth"))


_BAD = "psm_id % 50 = 0 OR psm_id % 60 = 7"


def _tab_lines(psms: DataFrame, path: str) -> str:
    """PSMs as tables with tabs and a header in each file: every 50th row has a field too many, some have a charge that is no number."""
    names = [f.name for f in schemas.PSMS]
    fields = ["CASE WHEN psm_id % 60 = 7 THEN 'two' ELSE cast(charge AS string) END" if n == "charge" else f"coalesce(cast({n} AS string), '')" for n in names]
    line = f"concat(concat_ws('\t', {', '.join(fields)}), CASE WHEN psm_id % 50 = 0 THEN '\tmore' ELSE '' END)"
    psms.select(F.expr(line).alias("\t".join(names))).write.option("header", True).option("sep", "\x01").csv(path)
    return path


@query(f"SELECT psm_id, peptide, charge, proteins, spectrum_q FROM psms WHERE NOT ({_BAD})")
def tsv_to_parquet_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _tab_lines(fx.psms(spark, sf_dir), new_path(spark)), new_path(spark)
    tables.tsv_to_parquet(spark, source, target, schemas.PSMS)
    return spark.read.parquet(target).select("psm_id", "peptide", "charge", "proteins", "spectrum_q")


@query(
    f"""SELECT label, psm_count, peptide_count, ion_count, protein_count FROM (SELECT concat('file', psm_id % 3) AS label, {_COUNTS} FROM psms WHERE peptide_q <= 0.01e0 AND (psm_id % 3 = 0 OR NOT ({_BAD})) GROUP BY 1)
JOIN (SELECT label, count(DISTINCT trim(p)) AS protein_count FROM (SELECT concat('file', psm_id % 3) AS label, unnest(string_split(proteins, ';')) AS p FROM psms WHERE peptide_q <= 0.01e0 AND (psm_id % 3 = 0 OR NOT ({_BAD}))) GROUP BY 1) USING (label)"""
)
def summary_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    psms = fx.psms(spark, sf_dir)
    parts = [psms.where(F.expr(f"psm_id % 3 = {i}")) for i in range(3)]
    paths = [new_path(spark) + ".parquet", _tab_lines(parts[1], new_path(spark)), _tab_lines(parts[2], new_path(spark))]
    parts[0].write.parquet(paths[0])
    return summary.compare(tables.read_many(spark, [(p, f"file{i}") for i, p in enumerate(paths)]), FDR, "peptide")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS sage_fragment_idx FROM events")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    fx.table(spark, sf_dir, "events").select("event_id").repartitionByRange(8, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return tables.with_row_position(spark, path)


_BETTER = "status = 'unreviewed' AND dataset = 'D3' AND cfg = '1-URGENT' AND search_engine = 'F' AND id <> 4"


@query(
    f"""SELECT id, CASE WHEN id = 4 THEN 'reviewed' WHEN {_BETTER} THEN 'bested' ELSE status END AS status, CASE WHEN id = 4 THEN 1 ELSE 0 END AS regression,
CASE WHEN id = 4 THEN 'checked' WHEN {_BETTER} THEN 'a better run' END AS message FROM runs UNION ALL SELECT max(id) + 1, 'unreviewed', 0, NULL FROM runs"""
)
def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = registry.Registry(spark, new_path(spark))
    book.init()
    book.adopt(fx.runs(spark, sf_dir))
    book.review(4, 1, "checked")
    new = book.record({"pipeline_path": "p", "dataset": "D3", "cfg": "1-URGENT", "search_engine": "F", "peptide_count": 10**9})
    book.mark_bested(new, "a better run")
    return book.runs().select("id", "status", "regression", "message")


@query("SELECT psm_id FROM fragments GROUP BY psm_id HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.repeated(fx.fragments(spark, sf_dir), "psm_id")


@query(
    _MERGED
    + """, odd AS (SELECT precursor_idx, CASE WHEN precursor_idx % 7 = 0 THEN 2 ELSE 234 END AS charges, fragment_spectrum_start AS s, fragment_event_cnt AS c FROM precursors WHERE precursor_idx % 10 <> 3
  UNION ALL SELECT precursor_idx, 234, fragment_spectrum_start, fragment_event_cnt FROM precursors WHERE precursor_idx % 50 = 1),
rows AS (SELECT 1 AS "check", precursor_idx AS key FROM odd GROUP BY precursor_idx HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 2, precursor_idx FROM merged WHERE precursor_idx % 10 = 3
  UNION ALL SELECT 3, precursor_idx FROM groups JOIN (SELECT precursor_idx, min(charges) AS own FROM odd GROUP BY precursor_idx) USING (precursor_idx)
    WHERE precursor_idx % 10 <> 3 AND precursor_idx % 50 <> 1 AND len(list_filter(string_split(cast(detected_charges AS varchar), ''), lambda d: NOT contains(cast(own AS varchar), d))) > 0
  UNION ALL SELECT DISTINCT 4, precursor_idx FROM odd, range(20) t(i) WHERE (s + i) NOT IN (SELECT fragment_idx FROM library WHERE fragment_idx % 13 <> 5)),
ranked AS (SELECT "check", count(*) OVER (PARTITION BY "check") AS total, key, row_number() OVER (PARTITION BY "check" ORDER BY key) AS n FROM rows)
SELECT "check", total, key FROM ranked WHERE n <= 20"""
)
def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = fx.precursors(spark, sf_dir)
    odd = good.where("precursor_idx % 10 <> 3").withColumn("charges", F.expr("cast(CASE WHEN precursor_idx % 7 = 0 THEN 2 ELSE 234 END AS bigint)"))
    odd = odd.unionByName(good.where("precursor_idx % 50 = 1"))
    merged = _merged(spark, sf_dir, odd.where("precursor_idx % 50 <> 1"))
    known = merged.where("precursor_idx % 50 <> 1")
    return mapping.violations(fx.psms(spark, sf_dir), odd, known, mapping.precursor_groups(known), fx.library(spark, sf_dir).where("fragment_idx % 13 <> 5"))


@query(_MERGED + "SELECT DISTINCT precursor_idx FROM merged WHERE precursor_idx % 10 = 3 ORDER BY precursor_idx LIMIT 20")
def first_unsubmitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.first_of(mapping.unsubmitted(_merged(spark, sf_dir, fx.precursors(spark, sf_dir).where("precursor_idx % 10 <> 3"))), "precursor_idx")


@query("SELECT precursor_idx, fragment_spectrum_start + i AS fragment_idx FROM precursors, range(20) t(i) WHERE (fragment_spectrum_start + i) NOT IN (SELECT fragment_idx FROM library WHERE fragment_idx % 13 <> 5)")
def missing_library_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.missing_peaks(fx.precursors(spark, sf_dir), fx.library(spark, sf_dir).where("fragment_idx % 13 <> 5")).select("precursor_idx", "fragment_idx")


@query("SELECT concat('S', s) AS title, cast(m AS double) AS max_mz FROM (SELECT cast(floor(fragment_idx / 20.0e0) AS bigint) AS s, max(intensity) AS m FROM library GROUP BY 1) ORDER BY max_mz DESC, title LIMIT 1")
def largest_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    _spectra(spark, sf_dir).select(F.concat("spectrum", F.lit("END IONS"))).write.text(path)
    return spectra.largest(spectra.max_fragment_mz(spectra.records(spark, path)))


@query("SELECT fragment_idx, mz, intensity FROM library")
def library_from_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    columns.write_columns(fx.library(spark, sf_dir), path, "fragment_idx")  # numbers from 0 without gaps
    return columns.read_columns(spark, path, ["mz", "intensity"], "fragment_idx")
