"""What is asked of trees is told where they are walked, and what most roots need is held by every task."""

import random

import pytest

from linkscope.operators import trees
from linkscope.plans import registry, scans  # noqa: F401  (these add their queries to the registry)
from tests.test_scans import plain_tree

ODD = ["odd\0name", "odd\1name", "odd\2aname", "odd\3d", "a -> b", ""]


def made(spark, n_roots, seed=0):
    dice = random.Random(n_roots + seed)
    libraries = [f"l{i}" for i in range(30)] + ODD
    follow = {x: dice.sample(libraries, dice.randint(1, 3)) for x in libraries[1:]} | {f"r{i}": dice.sample([*libraries, "lost"], dice.randint(0, 6)) for i in range(n_roots)}
    known = {x for x in follow if dice.random() < 0.9}
    edges = spark.createDataFrame([(a, b, i) for a, bs in follow.items() for i, b in enumerate(bs)], "src string, dst string, position int")
    roots = [f"r{i}" for i in range(n_roots)] + ["gone"]
    return follow, known, roots, (edges, spark.createDataFrame([(x,) for x in roots], "node string"), spark.createDataFrame([(k,) for k in sorted(known)], "path string"))


def above_walk(df):
    """Exchanges of rows that walks have made."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("MapInArrow")[0].count("Exchange")


@pytest.mark.parametrize("held, asked, size", [(0, 9, 1 << 20), (5, 4, 1 << 20), (30, 6, 1 << 20), (99, 99, 60), (99, 99, 1 << 20)])
@pytest.mark.parametrize("n_roots", [4, 70])
def test_trees_whatever_is_held(spark, monkeypatch, n_roots, held, asked, size):
    for name, value in (("HELD", held), ("ASKED", asked), ("HELD_BYTES", size), ("STARTS", 20)):
        monkeypatch.setattr(trees, name, value)
    follow, known, roots, given = made(spark, n_roots, held)
    rows = {}
    for r in trees.trees(*given, 4).orderBy("root", "position").collect():
        rows.setdefault(r.root, []).append(tuple(r)[1:])
    assert rows == {x: plain_tree(x, follow, known, 4) for x in roots}


def test_closed_files_hold_all_below_them():
    packs = ["+a\0b", "+b\0c", "-c", "+d\0lost", "+e\0d", "+f\0f\0a", "+g\0g\0e"]
    assert trees.closed(packs) == ["+a\0b", "+b\0c", "-c", "+f\0f\0a"]


def test_places_are_told_by_the_walk(spark, sf_dir):
    for n_roots in (4, 70):
        *_, given = made(spark, n_roots)
        told = trees.first_places_of(*given, 4)
        kept = trees.first_places(trees.trees(*given, 4))
        assert told.dtypes == kept.dtypes and sorted(map(str, told.collect())) == sorted(map(str, kept.collect()))
    assert above_walk(registry.QUERIES["tree_places"](spark, sf_dir)) == 0


def marked(spark, of):
    dice = random.Random(8)
    rows = [(f"l{i}", dice.choice(["S1", "S2", "odd\3\2b", "", None])) for i in range(30) for _ in range(dice.randint(0, 3))] + [("r1", "S1"), ("odd\0name", "S3"), ("a -> b", "S1"), ("gone", "S9"), (None, "S1")]
    return spark.createDataFrame(rows, "name string, symbol string").select(*of)


def same(told, kept):
    return told.dtypes == kept.dtypes and sorted(map(str, told.collect())) == sorted(map(str, kept.collect()))


def test_symbols_by_depth_are_told_by_the_walk(spark, sf_dir):
    *_, given = made(spark, 70)
    names = marked(spark, ["name", "symbol"])
    assert same(trees.symbols_by_depth_of(*given, names, 4), trees.symbols_by_depth(trees.trees(*given, 4), names))
    assert above_walk(registry.QUERIES["tree_symbols_by_depth"](spark, sf_dir)) == 0


def test_files_above_libraries_are_told_by_the_walk(spark, sf_dir):
    *_, given = made(spark, 70)
    names = marked(spark, ["name"])
    assert same(trees.has_library_below_of(*given, names, 4), trees.has_library_below(trees.trees(*given, 4), names))
    assert above_walk(registry.QUERIES["tree_transitive"](spark, sf_dir)) == 0


def test_chains_are_told_by_the_walk(spark, sf_dir):
    *_, given = made(spark, 70)
    names = marked(spark, ["name", "symbol"])
    assert same(trees.import_chains_of(*given, names, 4), trees.import_chains(trees.trees(*given, 4), names))
    assert above_walk(registry.QUERIES["tree_chains"](spark, sf_dir)) == 0


def test_files_are_told_few_times(spark, monkeypatch):
    *_, given = made(spark, 70)
    assert same(trees.collected_of(*given, 4), trees.collected(trees.trees(*given, 4)))
    seen = set()
    again = [("r", None, 0, "r", None), ("a", "r", 1, "", None), ("r", "a", 2, "", trees.CIRCULAR), ("lost", "a", 2, "", trees.MISSING)]
    assert [list(trees._files("r", again, None, seen)) for _ in range(2)] == [[("r",), ("a",)], []]
    monkeypatch.setattr(trees, "TOLD", 2)
    assert [x for x, in trees._files("b", [(x, None, 0, x, None) for x in "bcbc"], None, seen)] == ["b", "c"] and len(seen) <= 2


def test_roots_get_no_packs_of_files_that_tasks_hold(spark, monkeypatch):
    edges = spark.range(300).selectExpr("concat('r', id) as src", "concat('l', id % 7) as dst", "0 as position").unionByName(spark.range(9).selectExpr("concat('l', id) as src", "concat('l', id + 1) as dst", "0 as position"))
    given = edges, spark.range(300).selectExpr("concat('r', id) as node"), edges.selectExpr("src as path")
    monkeypatch.setattr(trees, "teller", lambda *_: lambda batches: batches)
    rows = trees.told(*given, None, "root string, pack string").collect()
    assert sorted(r.pack for r in rows) == sorted(f"+r{i}\0l{i % 7}" for i in range(300))
    monkeypatch.setattr(trees, "HELD", 0)
    assert trees.told(*given, None, "root string, pack string").count() == 600
