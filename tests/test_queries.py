"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, sf_dir)
    out = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([norm(r[names.index(c)]) for c in sorted(names)]) for r in out.fetchall())
    assert sorted(repr([norm(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
