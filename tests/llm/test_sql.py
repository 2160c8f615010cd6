"""Every corpus query with SQL against it, on whole tables."""

import os

import duckdb
import pytest

from spectrail.llm import catalog

SF = os.environ.get("SQL_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    assert got and got == sorted(repr([r[i] for i in place]) for r in found.fetchall())
