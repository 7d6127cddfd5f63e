"""The search for first paths reads only edges that lead on."""

from linkscope.operators import path_search


def test_edges_that_lead_nowhere_are_left_out(spark, monkeypatch):
    seen, walked, search = [], path_search.lengths, path_search.searched
    monkeypatch.setattr(path_search, "lengths", lambda hop, *a: seen.append(sorted(map(tuple, hop.select("src", "dst").collect()))) or walked(hop, *a))
    monkeypatch.setattr(path_search, "searched", lambda hop, *a: seen.append(sorted(map(tuple, hop.select("src", "dst").collect()))) or search(hop, *a))
    edges = spark.createDataFrame([(1, 2), (2, 9), (1, 5), (3, 4), (4, 6), (9, 1), (1, 9)], "src long, dst long")
    found = path_search.first_paths_to(edges, spark.createDataFrame([(9,)], "node long"), 5, 4).collect()
    assert sorted((r.src, tuple(r.path), r["rank"]) for r in found) == [(1, (1, 2, 9), 2), (1, (1, 9), 1), (2, (2, 9), 1)]
    assert seen[0] == [(1, 2), (1, 9), (2, 9), (3, 4)]
    assert seen[1] == [(1, 2), (1, 9), (2, 9)]
