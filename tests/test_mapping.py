import random

import numpy as np
import pytest

from spectrail import schemas
from spectrail.operators import mapping


def _tables(spark, exp, lib, cnt=None, charges=234, found=2, start=0):
    psms = spark.createDataFrame([(1, "p", found, "", f"precursor_idx=10 charge={found}", 0.0, 0.0, 0.0)], schemas.PSMS)
    fragments = spark.createDataFrame([(i, 1, float(np.float32(m))) for i, m in enumerate(exp)], schemas.FRAGMENTS)
    precursors = spark.createDataFrame([(10, start, len(lib) if cnt is None else cnt, charges)], schemas.PRECURSORS)
    library = spark.createDataFrame([(i, float(np.float32(m)), 1.0, 5) for i, m in enumerate(lib)], schemas.LIBRARY)
    return psms, fragments, precursors, library


def _brute(exp, lib, tol):
    out = {}
    for i, m in enumerate(map(np.float32, exp)):
        best = min(((abs(np.float32(x) - m), np.float32(x), k) for k, x in enumerate(lib)), default=None)
        if best and best[0] <= np.float32(tol):
            out[i] = best[2]
    return out


@pytest.mark.parametrize("seed,tol", [(1, 0.001), (2, 0.05), (3, 0.0)])
def test_nearest_matches_brute_force(spark, seed, tol):
    r = random.Random(seed)
    lib = sorted({round(r.uniform(200, 203), 3) for _ in range(200)})
    exp = [r.choice(lib) + r.choice([0, 0, 0.0005, -0.0004, 0.02, 0.3]) for _ in range(150)]
    psms, fragments, precursors, library = _tables(spark, exp, lib)
    got = mapping.nearest(mapping.resolve(fragments, psms, precursors), precursors, library, tol)
    assert {r.sage_fragment_idx: r.pmsms_fragment_idx for r in got.collect()} == _brute(exp, lib, tol)


def test_negative_tolerance_matches_nothing(spark):
    psms, fragments, precursors, library = _tables(spark, [200.0], [200.0])
    assert mapping.nearest(mapping.resolve(fragments, psms, precursors), precursors, library, -1.0).count() == 0


def test_equal_library_peaks(spark):
    psms, fragments, precursors, library = _tables(spark, [200.0, 201.0], [200.0, 200.0, 201.0])
    merged = mapping.resolve(fragments, psms, precursors)
    assert sorted(r.pmsms_fragment_idx for r in mapping.nearest(merged, precursors, library).collect()) == [0, 2]
    assert [r.pmsms_fragment_idx for r in mapping.nearest(merged, precursors, library, compat_stall=True).collect()] == [0]


def test_unmatched_precursors_stay_visible(spark):
    psms = spark.createDataFrame([(i, "p", c, "", f"precursor_idx={p} charge={c}", 0.0, 0.0, 0.0) for i, p, c in ((1, 10, 2), (2, 99, 3), (3, 30, 2))], schemas.PSMS)
    fragments = spark.createDataFrame([(i, i, 200.0) for i in (1, 2, 3)], schemas.FRAGMENTS)
    precursors = spark.createDataFrame([(10, 0, 1, 2), (30, 0, 1, 2)], schemas.PRECURSORS)
    merged = mapping.resolve(fragments, psms, precursors)
    assert [r.precursor_idx for r in mapping.unsubmitted(merged).collect()] == [99]
    with pytest.raises(mapping.IntegrityError, match="99"):
        mapping.validate(psms, precursors, merged, mapping.precursor_groups(merged))


def test_foreign_charge_and_gaps(spark):
    with pytest.raises(mapping.IntegrityError, match="charges"):
        mapping.map_fragments(*_tables(spark, [200.0], [200.0], charges=34))
    with pytest.raises(mapping.IntegrityError, match="library"):
        mapping.map_fragments(*_tables(spark, [200.0], [200.0], cnt=5))


def test_charges_pack_in_the_order_of_text(spark):
    df = spark.createDataFrame([(1, c) for c in (3, 2, 10, 2, None)], "k int, charge int")
    from spectrail.functions.scalars import packed_digits

    assert df.groupBy("k").agg(packed_digits(df.charge).alias("x")).first().x == 1023


def test_scan_without_keys_fails_loudly(spark):
    bad = spark.createDataFrame([(1, "p", 2, "", "nothing", 0.0, 0.0, 0.0)], schemas.PSMS)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        mapping.scan_keys(bad).collect()


def test_tables_without_hits(spark, tmp_path):
    from spectrail.sources import tables

    found = mapping.map_fragments(*_tables(spark, [500.0], [200.0]))
    assert found.mapping.count() == 0 and found.precursors.count() == 0
    rows = found.mz_delta_quantiles.collect()
    assert len(rows) == 101 and all(r.mz_delta is None for r in rows)
    tables.write_mapping(found, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "mapping.parquet")).columns == [f.name for f in schemas.MAPPING]


def test_offsets_and_rows_agree(spark):
    lib = [200.0 + i for i in range(5)]
    found = mapping.map_fragments(*_tables(spark, lib * 2, lib))
    rows = found.mapping.orderBy("mapping_row").collect()
    assert [r.mapping_row for r in rows] == list(range(10))
    assert found.precursors.first().asDict() == {"precursor_idx": 10, "detected_charges": 2, "submitted_charges": 234, "mapped_idx": 0, "mapped_cnt": 10}


def test_offsets_run_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(mapping, "BUCKET", 3)
    r = random.Random(8)
    wanted = {i: r.randint(1, 4) for i in r.sample(range(40), 25)}
    hits = spark.createDataFrame([(i,) for i, n in wanted.items() for _ in range(n)], "precursor_idx long")
    groups = spark.createDataFrame([(i, 2, 2) for i in wanted], "precursor_idx long, detected_charges long, submitted_charges long")
    at = 0
    for row in mapping.mapped_counts(hits, groups).orderBy("precursor_idx").collect():
        assert (row.mapped_idx, row.mapped_cnt) == (at, wanted[row.precursor_idx])
        at += row.mapped_cnt


def _many(spark, seed, hot=False):
    """Several precursors, most rows of one where ``hot``; equal library peaks, ties and peaks on both sides."""
    r = random.Random(seed)
    library, precursors, exp = [], [], {}
    for p in range(1 if hot else 12):
        n = 4000 if hot else r.randrange(1, 40)
        own = sorted(float(np.float32(r.uniform(300, 900))) for _ in range(n))
        own = sorted(own + r.sample(own, n // 4))
        precursors.append((p, len(library), len(own), 2))
        library += own
        exp[p] = [float(np.float32(r.choice(own) + r.choice([0, 0.0004, -3, 8, 200, -700]))) for _ in range(3000 if hot else 60)]
    psms = [(p, "p", 2, "", f"precursor_idx={p} charge=2", 0.0, 0.0, 0.0) for p in exp]
    fragments = [(i, p, m) for i, (p, m) in enumerate((p, m) for p, ms in exp.items() for m in ms)]
    lib = [(i, m, 1.0, 5) for i, m in enumerate(library)]
    return [spark.createDataFrame(rows, s) for rows, s in ((psms, schemas.PSMS), (fragments, schemas.FRAGMENTS), (precursors, schemas.PRECURSORS), (lib, schemas.LIBRARY))], fragments, precursors, library


@pytest.mark.parametrize("tolerance", [0.001, 10.0, 1e9])
@pytest.mark.parametrize("hot", [False, True])
def test_sorted_search_equals_brute_force(spark, tolerance, hot):
    (psms, fragments, precursors, library), rows, slices, lib = _many(spark, 4, hot)
    merged = mapping.resolve(fragments, psms, precursors)
    found = mapping.nearest(merged, precursors, library, tolerance, sort=True)
    expected = {}
    for p, start, n, _ in slices:
        own = np.array(lib[start : start + n], np.float32)
        for i, q, m in rows:
            if q == p:
                d = np.abs(own - np.float32(m))
                k = min(range(n), key=lambda j: (d[j], own[j], j)) if not hot else int(np.lexsort((own, d))[0])
                if d[k] <= np.float32(tolerance):
                    expected[i] = start + k
    assert {r.sage_fragment_idx: r.pmsms_fragment_idx for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan.split("FileScan")[0]


def test_a_hot_group_lies_in_several_ranges(spark):
    from spectrail.operators.nearest import nearest_sorted

    rng = np.random.default_rng(1)
    q = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(rng.normal(size=2000))] + [(1, -1, 5.0), (2, -2, None), (2, -3, float("nan"))], "g int, i int, x double")
    values = np.sort(np.round(rng.normal(size=500), 2))
    c = spark.createDataFrame([(0, float(v), k) for k, v in enumerate(values)] + [(0, None, 900), (0, float("nan"), 901), (2, 1.0, 902)], "g int, v double, k int")
    got = {r.i: r.near for r in nearest_sorted(q, c, "g", "x", "v", "k", rows_per_range=50).collect()}
    assert len(got) == 2003 and got[-1] is None and got[-2] is None and got[-3] is None
    for r in q.where("g = 0").collect():
        d = np.abs(values - r.x)
        assert got[r.i].place == min(range(500), key=lambda j: (d[j], values[j], j))


def test_wide_tolerance_is_sorted_by_itself(spark):
    (psms, fragments, precursors, library), *_ = _many(spark, 5)
    merged = mapping.resolve(fragments, psms, precursors)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(mapping.nearest(merged, precursors, library, 1.0)) == rows(mapping.nearest(merged, precursors, library, 1.0, sort=False))
    assert mapping.nearest(merged, precursors, library, -1.0, sort=True).count() == 0


def test_repeated_keys_raise(spark):
    psms, fragments, precursors, library = _tables(spark, [200.0], [200.0])
    merged = mapping.resolve(fragments, psms, precursors)
    groups = mapping.precursor_groups(merged)
    mapping.validate(psms, precursors, merged, groups, library)
    with pytest.raises(mapping.IntegrityError, match="1 x psm_id that repeats; the first: .1."):
        mapping.validate(psms.union(psms), precursors, merged, groups)
    with pytest.raises(mapping.IntegrityError, match="1 x precursor_idx that repeats; the first: .10."):
        mapping.validate(psms, precursors.union(precursors), merged, groups)
