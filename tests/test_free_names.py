"""Names with free numbers against a plain loop."""

import random

import pytest

from linkscope.functions import text
from linkscope.operators import free_names as names
from linkscope.operators import resolve
from linkscope.operators.free_names import free_names


def plain(rows):
    taken, out = set(), []
    for group, stem, ending, at in sorted(rows, key=lambda r: (r[0], r[3])):
        number = None
        while (group, stem + (f"_{number}" if number else "") + ending) in taken:
            number = (number or 1) + 1
        taken.add((group, stem + (f"_{number}" if number else "") + ending))
        out.append((group, stem, ending, at, number))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame(rows, "box string, s string, e string, at_ long")
    return sorted((tuple(r) for r in free_names(df, "box", "s", "e", ["at_"]).select("box", "s", "e", "at_", "number").collect()), key=repr)


CASES = {
    "empty": [],
    "none in the way": ["a", "b", "a", "a"],
    "borne before": ["a_2", "a", "a", "a"],
    "borne after": ["a", "a", "a_2", "a"],
    "down two numbers": ["a", "a", "a_2", "a_2_2", "a_2", "a", "a_3_2", "a_3"],
    "numbers that are none": ["a_1", "a_02", "a", "a", "a_", "_2", "_", "", "", "_2"],
    "gap": ["a_3", "a", "a_5", "a", "a", "a_4", "a", "a"],
}


@pytest.mark.parametrize("name", CASES)
def test_free_names(spark, name):
    rows = [("x", s, ".z", i) for i, s in enumerate(CASES[name])]
    assert got(spark, rows) == plain(rows)


def test_free_names_of_random_rows(spark):
    r = random.Random(5)
    stems = ["a", "a_2", "a_3", "a_2_2", "a_2_3", "a_4", "b", "b_2_2"]
    rows = [(f"g{i % 60}", r.choice(stems), r.choice([".z", ""]), i) for i in range(1500)]
    assert got(spark, rows) == plain(rows)


def test_planned_names_are_distinct(spark):
    names = ["m.hap", "m_2.hap", "x/m.hap", "y/m.hap", "m_2.har"]
    df = spark.createDataFrame([("in/box.app", n, i) for i, n in enumerate(names)], "container string, entry string, position long")
    shown = {r["entry"]: r["display_name"] for r in resolve.planned(df).collect()}
    assert shown == {"m.hap": "box_m.hap", "m_2.hap": "box_m_2.hap", "x/m.hap": "box_m_3.hap", "y/m.hap": "box_m_4.hap", "m_2.har": "box_m_2.har"}


@pytest.mark.parametrize("most", [0, 24])
def test_large_groups_have_the_same_names(spark, monkeypatch, most):
    monkeypatch.setattr(names, "MOST", most)
    r = random.Random(7)
    stems = ["a", "a_2", "a_3", "a_2_2", "b"]
    rows = [(f"g{int(r.random() ** 2 * 20)}", r.choice(stems), r.choice([".z", ""]), i) for i in range(500)]
    assert got(spark, rows) == plain(rows)


def test_small_groups_take_few_jobs(spark):
    rows = [(f"g{i % 9}", s, ".z", i) for i, s in enumerate(["a", "a_2", "a_2_2", "a"] * 60)]
    spark.sparkContext.setJobGroup("free names", "")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("free names")) <= 8


def test_endings_are_those_of_the_last_dot(spark):
    texts = ["", ".", "a", ".hap", "a.", "a.b.hap", "a.hap\n", "ä.ö.Hap", "a\n.b\nc", "..", "a..b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = df.select("t", text.ending(df.t), text.without_ending(df.t)).collect()
    assert [(t, e, s) for t, e, s in shown] == [(t, t[t.rfind("."):] if "." in t else "", t[:t.rfind(".")] if "." in t else t) for t in texts]
