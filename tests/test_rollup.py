import random

from pyspark.sql import functions as F

from spectrail.operators import rollup, summary

SCHEMA = "file string, peptide string, charge int, proteins string"


def _rows(seed, n=600):
    r = random.Random(seed)
    return [(f"f{r.randrange(4)}", r.choice([None, "", *(f"p{i}" for i in range(30))]), r.choice([None, 2, 3]), r.choice([None, "", "a;b", "a; b;", *(f"q{i};q{i + 1}" for i in range(20))])) for _ in range(n)]


def _counts(df):
    return [tuple(r[c] for c in summary.COUNTS) for r in df.collect()]


def test_merged_counts_equal_counts_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(rollup, "PER_BUCKET", 7)
    psms = spark.createDataFrame(_rows(1), SCHEMA)
    found = rollup.keys(psms, F.col("file"))
    codes = rollup.dictionary(found)
    for kind, n in codes.groupBy("kind").count().collect():
        assert sorted(r.code for r in codes.where(F.col("kind") == kind).collect()) == list(range(n))
    bits = rollup.bitmaps(found, codes)
    assert _counts(rollup.merged_counts(bits)) == _counts(summary.count_all(psms))
    each = {r["by"]: tuple(r[c] for c in summary.COUNTS) for r in rollup.merged_counts(bits, "by").collect()}
    assert each == {r["file"]: tuple(r[c] for c in summary.COUNTS) for r in summary.count_all(psms, "file").collect()}
    some = bits.where("by IN ('f0', 'f2')")
    assert _counts(rollup.merged_counts(some)) == _counts(summary.count_all(psms.where("file IN ('f0', 'f2')")))


def test_new_files_keep_older_bitmaps(spark):
    first, second = (spark.createDataFrame(_rows(s, 200), SCHEMA) for s in (2, 3))
    second = second.withColumn("peptide", F.concat("peptide", F.lit("x")))
    a = rollup.keys(first, F.lit("a"))
    codes = rollup.dictionary(a)
    b = rollup.keys(second, F.lit("b"))
    more = rollup.dictionary(b, codes)
    assert more.join(codes, ["code", "kind"], "left_semi").count() == codes.count() and more.count() > codes.count()
    bits = rollup.bitmaps(a, codes).unionByName(rollup.bitmaps(b, more))
    assert _counts(rollup.merged_counts(bits)) == _counts(summary.count_all(first.unionByName(second)))


def test_no_rows(spark):
    found = rollup.keys(spark.createDataFrame([], SCHEMA), F.lit("a"))
    assert _counts(rollup.merged_counts(rollup.bitmaps(found, rollup.dictionary(found)))) == [(0, 0, 0, 0)]


def test_plan_has_no_expand(spark):
    psms = spark.createDataFrame(_rows(4), SCHEMA)
    found = rollup.keys(psms, F.lit(1))
    plan = rollup.merged_counts(rollup.bitmaps(found, rollup.dictionary(found)))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
