"""Trees of many roots that share what is below, and of few."""

import random

import pytest

from linkscope.operators import trees
from tests.test_scans import plain_tree


@pytest.mark.parametrize("n_roots", [3, 60])
def test_trees_of_many_and_of_few_roots(spark, n_roots):
    dice = random.Random(n_roots)
    libraries = [f"l{i}" for i in range(12)] + ["odd\0name", "odd\1name", "odd\2aname"]
    follow = {x: dice.sample(libraries, 3) for x in libraries[1:]} | {f"r{i}": dice.sample([*libraries, "lost"], dice.randint(0, 6)) for i in range(n_roots)}
    follow = {a: list(dict.fromkeys(bs)) for a, bs in follow.items()}
    known = {x for x in follow if dice.random() < 0.9}
    edges = spark.createDataFrame([(a, b, i) for a, bs in follow.items() for i, b in enumerate(bs)], "src string, dst string, position int")
    roots = [f"r{i}" for i in range(n_roots)] + ["gone"]
    files = spark.createDataFrame([(k,) for k in sorted(known)], "path string")
    for most in (2, 20):
        found = trees.trees(edges, spark.createDataFrame([(x,) for x in roots], "node string"), files, most)
        rows = {}
        for r in found.orderBy("root", "position").collect():
            rows.setdefault(r.root, []).append(tuple(r)[1:])
        assert rows == {x: plain_tree(x, follow, known, most) for x in roots}


def test_many_trees_make_few_groups_of_their_own(spark):
    """A library that all roots need is followed once, so no level has a row for each root."""
    edges = spark.range(2000).selectExpr("concat('r', id) as src", "'l0' as dst", "0 as position").unionByName(spark.range(15).selectExpr("concat('l', id) as src", "concat('l', id + 1) as dst", "0 as position"))
    roots = spark.range(2000).selectExpr("concat('r', id) as node")
    asked = []
    was = trees.descendants
    trees.descendants = lambda e, nodes, depth: asked.append(nodes.count()) or was(e, nodes, depth)
    try:
        found = trees.trees(edges, roots, edges.selectExpr("src as path"))
    finally:
        trees.descendants = was
    assert asked == [1] and found.count() == 2000 * 17
