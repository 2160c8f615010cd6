import pytest

from spectrail import schemas
from spectrail.operators import summary


def _psms(spark, rows):
    return spark.createDataFrame([(i, p, c, pr, None, q, q, q) for i, (p, c, pr, q) in enumerate(rows)], schemas.PSMS)


def test_ions_count_tuples_with_nulls(spark):
    df = _psms(spark, [("a", 1, None, 0.0), ("a", None, None, 0.0), (None, 1, None, 0.0), (None, None, None, 0.0), ("a", 1, None, 0.0)])
    row = summary.count_all(df).first()
    assert (row.psm_count, row.peptide_count, row.ion_count, row.protein_count) == (5, 1, 4, 0)


def test_proteins_are_trimmed_and_empty_names_stay(spark):
    df = _psms(spark, [("a", 1, "A; B;;A ", 0.0), ("b", 1, "", 0.0), ("c", 1, None, 0.0)])
    assert summary.count_all(df).first().protein_count == 3


def test_filter_is_inclusive_and_drops_null_and_nan(spark):
    df = _psms(spark, [("a", 1, "", 0.01), ("b", 1, "", None), ("c", 1, "", float("nan")), ("d", 1, "", 0.011)])
    assert [r.peptide for r in summary.fdr_filter(df, 0.01, "psm").collect()] == ["a"]


def test_float_q_values_are_compared_as_floats(spark):
    df = spark.createDataFrame([(0.05,), (0.06,)], "peptide_q float")
    assert summary.fdr_filter(df, 0.05).count() == 1


def test_unknown_level(spark):
    with pytest.raises(KeyError):
        summary.fdr_filter(_psms(spark, []), 0.01, "run")


def test_compare_keeps_labels_without_passing_rows(spark):
    df = _psms(spark, [("a", 1, "P", 0.0), ("b", 1, "P", 0.9), ("c", 2, "Q", 0.0), ("d", 2, "Q", 0.0)])
    df = df.withColumn("label", df.psm_id.cast("int").cast("string")).replace({"2": "x", "3": "x"}, subset=["label"])
    assert [(r.label, r.psm_count, r.protein_count) for r in summary.compare(df).collect()] == [("x", 2, 1), ("0", 1, 1), ("1", 0, 0)]


def test_filter_reaches_the_scan(spark, tmp_path):
    _psms(spark, [("a", 1, "P", 0.0)]).write.parquet(str(tmp_path / "x.parquet"))
    plan = summary.fdr_filter(spark.read.parquet(str(tmp_path / "x.parquet"))).select("psm_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(peptide_q,0.01)" in plan and "scannr" not in plan
