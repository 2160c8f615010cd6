import pytest
from pyspark.sql import types as T

from spectrail.sources import tables

SCHEMA = T.StructType().add("psm_id", "long").add("peptide", "string").add("charge", "integer").add("q", "double")


def test_bad_rows_go_whatever_is_read(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("psm_id\tpeptide\tcharge\tq\n1\tA\t2\t0.1\n2\tB \"q\t3\tnan\r\n3\tC\n4\t\t\t\n5\tD\t2\t0.1\textra\n\n6\tE\tbad\t0.2\n7\t F \t 2\t1e-3\n")
    df = tables.read_tsv(spark, str(tmp_path / "x.tsv"), SCHEMA)
    assert df.count() == df.select("peptide").count() == df.where("psm_id > 0").count() == 4
    rows = {r.psm_id: r for r in df.collect()}
    assert rows[2].peptide == 'B "q' and rows[2].q != rows[2].q
    assert rows[4].peptide is None and rows[4].charge is None
    assert rows[7].peptide == " F " and rows[7].charge == 2


def test_header_is_found(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("1\tA\t2\t0.5\n2\tB\t3\t0.5\n")
    assert tables.read_tsv(spark, str(tmp_path / "x.tsv"), SCHEMA, header="auto").count() == 2
    (tmp_path / "y.tsv").write_text("a\tb\nc\td\n")
    assert tables.read_tsv(spark, str(tmp_path / "y.tsv"), header="auto").columns == ["a", "b"]


def test_empty_file_and_missing_file(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("")
    assert tables.read_tsv(spark, str(tmp_path / "x.tsv"), SCHEMA).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_results(spark, str(tmp_path / "none.parquet"))


def test_convert_and_positions(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("psm_id\tpeptide\tcharge\tq\n" + "".join(f"{i}\tP\t2\t0.1\n" for i in range(50)))
    tables.tsv_to_parquet(spark, str(tmp_path / "x.tsv"), str(tmp_path / "x.parquet"), SCHEMA, files=1)
    rows = tables.with_row_position(spark, str(tmp_path / "x.parquet"), "place").collect()
    assert sorted((r.place, r.psm_id) for r in rows) == [(i, i) for i in range(50)]
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "many.parquet"))
    assert sorted(r.place for r in tables.with_row_position(spark, str(tmp_path / "many.parquet"), "place").collect()) == list(range(40))


def test_discovery(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/results.sage.tsv").write_text("x")
    (tmp_path / "e").mkdir()
    found, empty = tables.discover([str(tmp_path / "a"), str(tmp_path / "e")])
    assert [label for _, label in found] == ["b/results.sage.tsv"] and empty == [str(tmp_path / "e")]


def test_stream_ends_with_what_is_there(spark, tmp_path):
    from spectrail import schemas
    from spectrail.streaming.results import filter_arriving

    rows = [(i, "p", 2, "", "", 0.0, 0.005 * i, 0.0) for i in range(10)]
    spark.createDataFrame(rows, schemas.PSMS).write.parquet(str(tmp_path / "in"))
    filter_arriving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_discovery_by_the_reader(spark, tmp_path):
    for name in ("a/results.sage.tsv", "a/b c/d/results.sage.tsv", "a/other.tsv", "e/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("psm_id\tpeptide\n")
    root = f"file://{tmp_path}"
    found, empty = tables.discover([f"{root}/a", f"{root}/e", f"{root}/a/other.tsv"], spark=spark)
    assert [label for _, label in found] == ["b c/d/results.sage.tsv", "results.sage.tsv"] and empty == [f"{root}/e", f"{root}/a/other.tsv"]
    assert [p for p, _ in found] == [f"{root}/a/b c/d/results.sage.tsv", f"{root}/a/results.sage.tsv"]
    local, _ = tables.discover([str(tmp_path / "a")])
    assert [label for _, label in found] == [label for _, label in local]
    assert tables.discover([f"{root}/a/other.tsv"], "*.tsv", spark)[0] == [(f"{root}/a/other.tsv", f"{root}/a/other.tsv")]
    assert [label for _, label in tables.discover([f"{root}/a"], "*/*/results.*", spark)[0]] == ["b c/d/results.sage.tsv"]
    with pytest.raises(FileNotFoundError):
        tables.discover([f"{root}/none"], spark=spark)
    with pytest.raises(FileNotFoundError):
        tables.read_results(spark, f"{root}/none.parquet")
    with pytest.raises(ValueError):
        tables.discover([f"{root}/a"])


def test_many_files_by_their_urls(spark, tmp_path):
    from spectrail import schemas

    names = [f.name for f in schemas.PSMS]
    for i in range(2):
        (tmp_path / f"r{i}").mkdir()
        (tmp_path / f"r{i}/results.sage.tsv").write_text("\t".join(names) + "\n" + f"{i}\tp\t2\tq\ts\t0\t0\t0\n" * (i + 1))
    found, _ = tables.discover([f"file://{tmp_path}"], spark=spark)
    rows = tables.read_many(spark, found).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in rows} == {"r0/results.sage.tsv": 1, "r1/results.sage.tsv": 2}


def test_scratch_is_removed(spark):
    from urllib.parse import urlparse

    from spectrail.sources import shared

    with shared.scratch(spark):
        path = shared.new_path(spark)
        spark.range(3).write.parquet(path)
        kept = shared.saved(spark.range(5))
        assert kept.count() == 5 and __import__("os").path.exists(urlparse(path).path)
    assert not __import__("os").path.exists(urlparse(path).path)
    assert shared.saved(spark.range(2)).count() == 2


def test_labels_of_files_and_heads_need_no_sorted_rows(spark, tmp_path):
    from spectrail import schemas

    names = [f.name for f in schemas.PSMS]
    orders = [names, [*names[::-1], "more"]]
    files = [(str(tmp_path / f"{i}.tsv"), f"f{i}") for i in range(2)]
    for i, (path, _) in enumerate(files):
        row = {"psm_id": str(i), "peptide": "p", "charge": "2", "more": "m"}
        (tmp_path / f"{i}.tsv").write_text("\n" + "\t".join(orders[i]) + "\n" + ("\t".join(row.get(n, "") for n in orders[i]) + "\n") * (500 + i))
    # files of several splits
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        heads = tables._heads(spark, [p for p, _ in files])
        assert {r["_file"].rsplit("/", 1)[-1]: r["head"] for r in heads.collect()} == {f"{i}.tsv": "\t".join(orders[i]) for i in range(2)}
        assert "Sort" not in heads._jdf.queryExecution().executedPlan().toString()
        df = tables.read_many(spark, files)
        assert {(r["label"], r["psm_id"]): r["count"] for r in df.groupBy("label", "psm_id").count().collect()} == {("f0", 0): 500, ("f1", 1): 501}
        # rows of one file are neither dealt to one task nor sorted
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
