"""Every query with SQL gives the rows of that SQL."""

import glob
import os

import duckdb
import pytest

from linkscope.plans import registry, scans, summaries  # noqa: F401  (these add their queries to the registry)


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, database, name):
    df = registry.QUERIES[name](spark, sf_dir)
    expected = database.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert plain(df.columns, df.collect()) == plain(expected.columns, expected.fetchall())
