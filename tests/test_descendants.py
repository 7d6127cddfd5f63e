"""All that is below each root."""

import random

import pytest
from pyspark.sql import functions as F

from linkscope.operators import summary
from tests.llm.test_disk import left_by


@pytest.mark.parametrize("again", [0, 4, 10**9])
def test_least_depths_however_often_levels_are_held_against_those_before(spark, monkeypatch, again):
    monkeypatch.setattr(summary, "AGAIN", again)
    dice = random.Random(1)
    edges = [(a, b) for a in range(40) for b in dice.sample(range(60), 3)] + [(1, None)]
    expected = set()
    for root in (0, 1, 2, 99):
        low, front = {root: 0}, {root}
        for i in range(1, 5):
            front = {b for a, b in edges if a in front and a is not None} - set(low)
            low |= dict.fromkeys(front, i)
        expected |= {(root, node, i) for node, i in low.items()}
    e = spark.createDataFrame(edges, "src long, dst long")
    got = summary.descendants(e, spark.createDataFrame([(0,), (1,), (2,), (99,)], "node long"), 4).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_levels_leave_no_shuffle_files(spark):
    edges = spark.range(3000).selectExpr("id as src", "id div 3 as dst").where("src > dst")
    left, found = left_by(spark, lambda: summary.descendants(edges, edges.select(F.col("src").alias("node"))))
    assert left == 0 and found.where("depth = 1").count() == 2999
