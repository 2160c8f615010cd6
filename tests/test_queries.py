"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from spectrail.plans import catalog

SF = "/root/testdata/sf0.001"


def _value(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else repr(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in ("orders", "part", "customer", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(_value(r[i]) for i in place) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
