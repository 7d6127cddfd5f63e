"""Joins by parts of strings, by places and by beginnings, against plain loops."""

import random

import pytest

from linkscope.operators import intervals, prefixes, substrings


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_all_marks_in_all_strings(spark, block_bytes):
    r = random.Random(2)
    strings = ["".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in range(200)] + [None, "", "漢字ab漢", "a" * 50000]
    marks = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(60)} | {"a", "aa", "aab", "漢", "字a", ""}
    df = spark.createDataFrame([(i, s, i % 3) for i, s in enumerate(strings)], "id long, string string, other long")
    got = substrings.occurrences(df, "string", spark.createDataFrame([(m,) for m in [*marks, "a", None]], "mark string"), "mark", block_bytes)
    assert got.columns == ["id", "other", "mark"] and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted((i, i % 3, m) for i, s in enumerate(strings) if s is not None for m in marks if m in s)
    assert substrings.occurrences(df, "string", spark.createDataFrame([], "mark string"), "mark").collect() == []


@pytest.mark.parametrize("per_task", [50, 1 << 20])
def test_innermost_of_any_intervals(spark, per_task):
    r = random.Random(3)
    spans = [(r.choice("fgh"), (s := r.randrange(100)), s + r.choice([0, 0, 1, 5, 20, 60]), i) for i in range(120)] + [("f", 0, 100, 500), ("f", 10, 20, 501), ("f", 20, 30, 502), ("f", 10, 30, 503), (None, 0, 9, 504), ("g", None, 9, 505), ("g", 0, None, 506)]
    points = [(r.choice("fghk"), r.randrange(-2, 120), i) for i in range(600)] + [(None, 5, 600), ("f", None, 601)] + [("f", 15, 602)] * 3
    got = intervals.innermost(spark.createDataFrame(points, "file string, line long, id long"), spark.createDataFrame(spans, "file string, start long, end long, label long"), "file", "line", per_task)

    def plain(f, at):
        inside = [(-s, e, n) for g, s, e, n in spans if None not in (g, s, e, f, at) and g == f and s <= at < e]
        return min(inside)[2] if inside else None

    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((f, at, i, plain(f, at))) for f, at, i in points)


def test_places_inside_a_text():
    spans = [(0, 100, "a"), (10, 20, "b"), (12, 15, "c"), (20, 20, "empty"), (20, 30, "d")]
    assert list(intervals.around_all([0, 11, 12, 15, 19, 20, 30, 100], spans)) == ["a", "b", "c", "b", "b", "d", "a", None]


def test_first_file_by_prefix(spark):
    files = [("/a/libssl.so.3", 4), ("/b/libssl.so.1.1", 2), ("/a/libcrypto.so", 3), ("/z/plain", 1), ("/q/", 0), (None, 9), ("/a/libssl.so.3", 8)]
    nodes = ["/x/libssl.so.1.1.9", "/x/libssl.so", "/a/libcrypto.so", "/y/libcrypto.so.9", "/y/plain.so.2", "/y/pla", "/y/", "none", "/a/libssl.so.3", None, "/y/pla"]

    def plain(node):
        base, known = node.split("/")[-1], sorted((o, p) for p, o in files if p is not None)
        if any(p == node for _, p in known):
            return node
        fits = lambda p: (n := p.split("/")[-1]).startswith(base) or base.startswith(n.split(".so")[0] + ".so")
        return next((p for _, p in known if fits(p)), None) if base else None

    got = prefixes.first_by_prefix(spark.createDataFrame([(n,) for n in nodes], "path string"), spark.createDataFrame(files, "path string, ord long"))
    assert {r.path: r.file for r in got.collect()} == {n: plain(n) for n in nodes if n is not None} and got.count() == len(set(nodes)) - 1
