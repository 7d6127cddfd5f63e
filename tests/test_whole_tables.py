"""Queries over all rows and whole texts, against plain Python."""

import re

from linkscope.operators import graph
from linkscope.plans import registry, scans, summaries  # noqa: F401  (these add their queries to the registry)


def walks(edges, targets, depth):
    """All simple paths to a first target, forwards and one at a time."""
    out, stack = [], [[a, b] for a, b in set(edges) if a not in targets and a != b]
    while stack:
        path = stack.pop()
        if path[-1] in targets:
            out.append(path)
        elif len(path) <= depth:
            stack += [[*path, b] for a, b in set(edges) if a == path[-1] and b not in path]
    return sorted(out)


def test_paths_of_ten_hops_equal_brute_force(spark):
    edges = [(i, i + 1) for i in range(12)] + [(3, 6), (6, 3), (8, 8), (9, 5), (20, 11), (12, 0), (2, 20)]
    df, targets = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(12,), (20,)], "node long")
    got = graph.paths_to(df, targets, 10).collect()
    assert sorted(r.path for r in got) == walks(edges, {12, 20}, 10) and max(r.depth for r in got) == 10
    assert all(r.depth == len(r.path) - 1 and r.src == r.path[0] for r in got)


def test_graph_of(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    edges = {(r.l_orderkey, r.l_partkey * 40) for r in rows}
    stats = registry.QUERIES["graph_stats"](spark, sf_dir).first()
    assert (stats.n_edges, stats.n_nodes) == (len(edges), len({x for e in edges for x in e}))
    assert registry.QUERIES["graph_paths"](spark, sf_dir).where("depth > 5").count() > 0
    assert {r.root for r in registry.QUERIES["ranked_groups"](spark, sf_dir).collect()} == {a for a, _ in edges}


def test_path_functions_take_whole_texts(spark, sf_dir):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in registry.QUERIES["path_functions"](spark, sf_dir).collect()}
    assert got.keys() == html.keys() and max(map(len, html.values())) > 200
    for k, t in html.items():
        assert got[k].blanks == re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")
        assert got[k].cell == ("'" + t if t[:1] in ("=", "+", "-", "@") else t)
