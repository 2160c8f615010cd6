import pytest

from spectrail.llm import mixing
from spectrail.llm.tables import bucketed_before, components
from pyspark.sql import functions as F


def test_budgets_are_dealt_again():
    got = mixing.budgets([("a", 100), ("b", 1000), ("c", 10), (None, 0)], (3, 1, 2), 1.5, 2.0)
    assert got[None] == 0 and got["a"] == 200 and got["c"] == 20
    assert abs(sum(got.values()) - 1.5 * 1110) < 1e-6
    assert mixing.budgets([], (1,), 1.5, 2.0) == {}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_words_of_each_source_are_its_budget(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 4}") for i in range(300)] + [(900, None, None), (901, "", "hot"), (902, "x\x0by z", None)]
    found = mixing.mix(_docs(spark, rows))
    got = found.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    for source, rs in by.items():
        assert sum(r["size"] for r in rs) == rs[0].source_size
        assert sum(r.taken for r in rs) == int(rs[0].target) <= 2 * rs[0].source_size
    assert {r.doc_id: r["size"] for r in got}[902] == 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(_docs(spark, rows).repartition(5)).collect()))


def test_repeated_rows_and_empty_table(spark):
    assert mixing.mix(_docs(spark, [(1, "a b", "s")] * 3)).agg(F.sum("taken")).first()[0] == 9
    assert mixing.mix(_docs(spark, [])).count() == 0


def test_prefix_sums(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("k"), (F.col("id") % 5).alias("v"))
    rows = bucketed_before(df, ["k"], ["id"], F.col("v"), "before", rows_per_bucket=50).collect()
    for k in range(3):
        mine = sorted((r.before, r.before + r.v) for r in rows if r.k == k)
        reach = 0
        for low, high in mine:
            assert low == reach or low < reach == high  # rows of value 0 share a place
            reach = max(reach, high)
        assert reach == sum(r.v for r in rows if r.k == k)


@pytest.mark.parametrize("links,expected", [([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([(5, 9), (9, 2), (7, 8), (3, 3)], {2: 2, 5: 2, 9: 2, 7: 7, 8: 7}), ([], {})])
def test_components(spark, links, expected):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == expected


def test_the_table_equals_brute_force(spark):
    """The whole result: sizes, targets by dealing the excess again, and words taken along the order of hashes."""
    import re
    from fractions import Fraction

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    hashes = {(r.doc_id, r.n): r.h for r in spark.createDataFrame([(d, n) for d, _, n in rows], "doc_id long, n long").withColumn("h", F.xxhash64("doc_id", "n")).collect()}
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in rows if t == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), Fraction(3, 2) * sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: Fraction(2 * size[s]) for s in over}
        left, free = left - sum(2 * size[s] for s in over), [s for s in free if s not in over]
    expected = {}
    for s in names:
        words = int(target[s])
        whole, rest = divmod(words, size[s]) if size[s] else (0, 0)
        for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hashes[r[0], r[2]], r[0], r[2])):
            part = min(n, rest)
            rest -= part
            expected[d] = (n, size[s], float(target[s]), whole * n + part)
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.op2_mix(spark, "/root/testdata/sf0.01").collect()}
    assert len(rows) <= 1000 and got.keys() == expected.keys()
    assert all(got[d][:2] == e[:2] and got[d][2] == pytest.approx(e[2]) and got[d][3] == e[3] for d, e in expected.items())


def test_a_very_long_text(spark):
    got = {r.doc_id: r for r in mixing.mix(_docs(spark, [(1, "word " * 400_000, "s"), (2, "a b", "s"), (3, "c", "t")])).collect()}
    assert got[1]["size"] == 400_000 and got[1].taken <= 800_000 and got[1].source_size == 400_002
