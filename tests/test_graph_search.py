"""Bounded path search against plain enumeration."""

import random
import time

import pytest

from linkscope.operators import path_search
from tests.test_whole_tables import walks


def plain(edges, targets, n, depth):
    by = {}
    for p in walks(edges, targets, depth):
        by.setdefault(p[0], []).append(p)
    return {s: sorted(v, key=lambda p: (len(p), p))[:n] for s, v in by.items()}


def got(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        assert r.depth == len(r.path) - 1 and r["rank"] == len(out.get(r.src, [])) + 1
        out.setdefault(r.src, []).append(r.path)
    return out


@pytest.mark.parametrize("seed,nodes,links,n,keep", [(1, 9, 22, 3, None), (2, 8, 30, 2, 1), (3, 12, 20, 50, None)])
def test_first_paths_equal_brute_force(spark, seed, nodes, links, n, keep):
    r = random.Random(seed)
    edges = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(links)]
    targets = {0, 1}
    df = path_search.first_paths_to(spark.createDataFrame([*edges, edges[0], (None, 1)], "src long, dst long"), spark.createDataFrame([(t,) for t in targets], "node long"), n, 5, keep)
    assert got(df) == plain(edges, targets, n, 5)


def test_a_prefix_that_ends_in_a_cycle_is_made_up_for(spark):
    """Walks of the first prefixes lead back through the source only, so the search has to widen."""
    edges = [(9, i) for i in range(1, 6)] + [(i, 9) for i in range(1, 5)] + [(5, 7), (7, 8), (8, 0), (9, 6), (6, 0)]
    df = path_search.first_paths_to(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "node long"), 2, 6, 1)
    assert got(df) == plain(edges, {0}, 2, 6)


def test_diamonds_end_soon(spark):
    edges = [(f"{i:02d}", f"{i:02d}{s}") for i in range(12) for s in "ab"] + [(f"{i:02d}{s}", f"{i + 1:02d}") for i in range(12) for s in "ab"]
    start = time.perf_counter()
    out = got(path_search.first_paths_to(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("12",)], "node string"), 5, 24))
    assert len(out["00"]) == 5 and all(p[1::2][:9] == [f"{i:02d}a" for i in range(9)] for p in out["00"]) and len(out) == 36
    assert time.perf_counter() - start < 240


def test_no_edges(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert path_search.first_paths_to(empty, spark.createDataFrame([(1,)], "node long")).collect() == []
