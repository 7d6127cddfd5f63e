"""Layers against a queue written plainly, and numbers of rows against sorting."""

import random

import pytest

from linkscope.operators import layering, ordering


def plain(edges, extra=()):
    edges = sorted(set(edges))
    nodes = sorted({n for e in edges for n in e} | set(extra))
    after = {n: [b for a, b in edges if a == n] for n in nodes}
    todo = [n for n in nodes if all(b != n for _, b in edges)] or nodes[:1]
    layer = {n: 0 for n in todo}
    for n in todo:  # grows while it is read
        now = layer[n]
        for b in after[n]:
            if b not in layer:
                todo.append(b)
            layer[b] = max(layer.get(b, 0), now + 1)
    layer = {n: layer.get(n, 0) for n in nodes}
    place = {}
    for i in range(max(layer.values(), default=-1) + 1):
        def mean(n):
            up = [place[a] for a, b in edges if b == n and layer[a] == i - 1]
            return sum(up) / len(up) if up else 0.0
        for k, n in enumerate(sorted((n for n in nodes if layer[n] == i), key=lambda n: (mean(n), n))):
            place[n] = k
    return {(n, layer[n], place[n]) for n in nodes}


CASES = {
    "empty": [],
    "only a cycle": [(2, 3), (3, 4), (4, 2)],
    "itself": [(1, 1), (1, 2)],
    "cycle that no first node reaches": [(1, 2), (8, 9), (9, 8)],
    "raised after its turn": [(1, 2), (1, 3), (3, 4), (4, 2), (2, 5), (5, 6)],
    "raised before its turn": [(1, 2), (1, 3), (2, 3), (3, 4)],
    "repeated": [(1, 2), (1, 2), (2, 3)],
}


@pytest.mark.parametrize("name", CASES)
def test_layers(spark, name):
    got = {tuple(r) for r in layering.layers(spark.createDataFrame(CASES[name], "src long, dst long")).collect()}
    assert got == plain(CASES[name])


@pytest.mark.parametrize("seed,nodes,links", [(1, 8, 12), (2, 14, 22), (3, 30, 45)])
def test_layers_of_random_graphs(spark, seed, nodes, links):
    r = random.Random(seed)
    edges = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(links)]
    edges = [(f"n{a:02}", f"n{b:02}") for a, b in edges if a < b or r.random() < 0.2]
    more = spark.createDataFrame([("alone",), (None,)], "node string")
    rows = spark.createDataFrame([*edges, (None, "n01"), ("n01", None)], "src string, dst string")
    got = [tuple(x) for x in layering.layers(rows, more).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(edges, ["alone"])


@pytest.mark.parametrize("n,parts", [(0, 2), (1, 3), (5000, 7)])
def test_numbers_are_places(spark, n, parts):
    r = random.Random(n)
    rows = [(None if r.random() < 0.1 else r.randrange(40), i) for i in range(n)]
    df = spark.createDataFrame(rows, "_part long, _before long").repartition(parts)
    got = ordering.numbered(df, ["_part", "_before"], "place").collect()
    expected = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted((x["place"], x["_part"], x["_before"]) for x in got) == [(i, *x) for i, x in enumerate(expected)]


def test_rounds_read_edges_from_nodes_that_are_led_to(spark, monkeypatch):
    edges = [(100 + i, 1 + i % 2) for i in range(60)] + [(1, 2), (2, 3)]
    read, passed_on = [], layering.passed_on
    monkeypatch.setattr(layering, "passed_on", lambda e, given: read.append(e.count()) or passed_on(e, given))
    got = {tuple(r) for r in layering.layers(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain(edges) and read == [2]


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_where_something_leads_to_every_node(spark, seed):
    r = random.Random(seed)
    edges = [(i, (i + 1) % 9) for i in range(9)] + [(r.randrange(9), r.randrange(9)) for _ in range(6)]
    got = [tuple(x) for x in layering.layers(spark.createDataFrame(edges, "src long, dst long")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(edges)
