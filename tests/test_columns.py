import os

import numpy as np
import pytest

from spectrail.sources import columns


def _written(spark, tmp_path, n=1000, per_part=300):
    df = spark.range(n).selectExpr("id AS k", "cast(id / 3 AS float) AS mz", "cast(id * 2 AS double) AS score", "id % 7 AS intensity", "cast(id AS int) AS small").repartition(5)
    path = str(tmp_path / "lib")
    columns.write_columns(df, path, "k", per_part)
    return df, path


def test_round_trip_in_order(spark, tmp_path):
    df, path = _written(spark, tmp_path)
    found = columns.read_columns(spark, path, position="k", rows=128)
    assert found.dtypes == [("k", "bigint"), ("mz", "float"), ("score", "double"), ("intensity", "bigint"), ("small", "int")]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r[c] for c in found.columns) for r in df.collect())
    assert found.rdd.getNumPartitions() >= 1000 // 128


def test_other_columns_stay_closed(spark, tmp_path):
    _, path = _written(spark, tmp_path)
    for f in os.listdir(path):
        if f.endswith((".score", ".intensity", ".small")):
            os.unlink(f"{path}/{f}")
    assert columns.read_columns(spark, path, ["mz"], "k").where("k = 999").first().mz == np.float32(333.0)
    assert columns.read_columns(spark, "file://" + path, ["mz"]).count() == 1000
    with pytest.raises(Exception, match="score"):
        columns.read_columns(spark, path, ["score"]).collect()


def test_what_the_manifest_does_not_name_is_not_read(spark, tmp_path):
    _, path = _written(spark, tmp_path)
    np.arange(50, dtype="<f4").tofile(f"{path}/part-00000-dead.mz")
    assert columns.read_columns(spark, path, ["mz"]).count() == 1000
    with pytest.raises(ValueError, match="nowhere"):
        columns.read_columns(spark, path, ["nowhere"])
    with pytest.raises(Exception, match="exists"):
        columns.write_columns(spark.range(3).selectExpr("id AS k", "id AS x"), path, "k")


def test_short_file_and_nulls_are_errors(spark, tmp_path):
    _, path = _written(spark, tmp_path)
    name = next(f for f in os.listdir(path) if f.endswith(".mz"))
    os.truncate(f"{path}/{name}", 8)
    with pytest.raises(Exception, match="ends before row"):
        columns.read_columns(spark, path, ["mz"]).collect()
    with pytest.raises(Exception, match="nulls"):
        columns.write_columns(spark.range(3).selectExpr("id AS k", "nullif(id, 1) AS x"), str(tmp_path / "b"), "k")
    assert not columns.is_folder(str(tmp_path / "b"))


def test_empty_and_library(spark, tmp_path):
    columns.write_columns(spark.range(0).selectExpr("id AS k", "cast(id AS float) AS mz"), str(tmp_path / "none"), "k")
    assert columns.read_columns(spark, str(tmp_path / "none"), position="k").count() == 0
    _, path = _written(spark, tmp_path)
    assert columns.read_library(spark, path).columns == ["fragment_idx", "mz", "score", "intensity"]
    columns.read_library(spark, path).write.parquet(str(tmp_path / "p"))
    assert columns.read_library(spark, str(tmp_path / "p"), ["mz"]).columns == ["fragment_idx", "mz"]
