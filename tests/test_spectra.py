from pyspark.sql import functions as F

from spectrail.operators import calibration, spectra


def test_largest_first_number(spark, tmp_path):
    (tmp_path / "x.mgf").write_text("BEGIN IONS\nTITLE=a\nPEPMASS=9999\n100.5 3\n200.25 1\nEND IONS\nBEGIN IONS\nTITLE=b\n900 1\nTITLE=c\n50 2\n3 4 5\nEND IONS\nBEGIN IONS\nTITLE=d\n9000 1\n")
    rows = spectra.max_fragment_mz(spectra.records(spark, str(tmp_path / "x.mgf")))
    assert {(r.title, r.max_mz) for r in rows.collect()} >= {("a", 200.25)}
    assert 9000.0 not in [r.max_mz for r in rows.collect() if r.title != "d"]
    assert spectra.largest(rows.where("title = 'a'")).first().max_mz == 200.25


def test_spline_follows_a_bend(spark):
    rows = spark.range(2000).select((F.col("id") / 100).alias("expmass")).withColumn("ppm", F.col("expmass") * F.col("expmass") / 10 + F.rand(1) - 0.5)
    train, test = calibration.split(rows)
    found = calibration.spline(train, "ppm").predict(test)
    assert calibration.metrics(found, "ppm")["rmse"] < 0.6
    assert found.where("ppm BETWEEN low AND high").count() > 0.85 * found.count()
