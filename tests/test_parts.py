"""Large inputs are dealt over more partitions than the session has, with the same results."""

import glob
import os

import duckdb
import pytest

from linkscope.operators import parts, prefixes
from linkscope.plans import registry, scans, summaries  # noqa: F401  (these add their queries to the registry)


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", ["assigned_components", "banner_detection", "graph_fans", "graph_stats", "string_clusters", "library_calls"])
def test_partitions_follow_the_files(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(parts, "PART_BYTES", 4096)
    df = registry.QUERIES[name](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().toString()
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    expected = con.sql(registry.ORACLE_SQL[name])
    assert plain(df.columns, df.collect()) == plain(expected.columns, expected.fetchall())


def test_small_input_stays(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert parts.dealt(lines, "l_orderkey") is lines
    assert parts.file_bytes(lines) == os.path.getsize(f"{sf_dir}/lineitem.parquet")


def test_names_of_one_file_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "MOST_HEADS", 16)
    nodes = spark.createDataFrame([("a/lib",), ("a/libx.so.1",), ("q",)], "path string")
    files = spark.createDataFrame([(f"b/libx{i}.so", i) for i in range(40)] + [("a/libx.so", 99)], "path string, ord long")
    found = prefixes.first_by_prefix(nodes, files)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [("a/lib", "b/libx0.so"), ("a/libx.so.1", "a/libx.so"), ("q", None)]


def test_nodes_are_dealt_like_their_edges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", 4096)
    plan = registry.QUERIES["graph_stats"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(src" in x and "REPARTITION_BY_NUM" in x and "dst" not in x.split("hashpartitioning")[1] for x in plan.splitlines())
