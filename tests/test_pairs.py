"""Partners of call sites: one pass, and groups that many batches share."""

import random

import pytest

from linkscope.operators import diff
from linkscope.plans import adapters, registry
from tests.test_operators import partners


def test_call_sites_are_paired_in_one_pass(spark, sf_dir):
    group = "one pass of pairs"
    spark.sparkContext.setJobGroup(group, "")
    try:
        df = registry.QUERIES["diff_pairs"](spark, sf_dir)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    # the schemas of two files are read; nothing is matched before the one action
    assert jobs <= 2 and df.count() > 0


def test_sides_are_the_snapshots(spark, sf_dir):
    old, new = adapters.snapshots(spark, sf_dir)
    both = adapters.sides(spark, sf_dir)
    for side, rows in (("o", old), ("n", new)):
        got = both.where(f"{side} = 1").select(*rows.columns)
        assert got.count() == rows.count() and got.exceptAll(rows).isEmpty() and rows.schema["line"].dataType == got.schema["line"].dataType


@pytest.mark.parametrize("batch", [1, 2, 5])
def test_groups_over_batches(spark, batch):
    r = random.Random(batch)
    groups = {f"f{g}": tuple([(r.randrange(6), r.choice("xy")) for _ in range(r.randrange(5))] for _ in range(2)) for g in range(80)}
    # more on one side than on the other, of one line each
    groups["often"] = ([(1, "x")] * 5, [(4, "x")] * 3)
    side = lambda i: spark.createDataFrame([(g, "c", "s", line, args) for g, v in groups.items() for line, args in v[i]], "file string, caller string, symbol string, line int, args string")
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, got = spark.conf.get(most), {}
    spark.conf.set(most, str(batch))
    try:
        for x in diff.pairs(side(0), side(1)).collect():
            got.setdefault(x.file, []).append((x.old_line, x.old_args, x.new_line, x.new_args, x.status))
    finally:
        spark.conf.set(most, was)
    assert {g: sorted(map(str, v)) for g, v in got.items()} == {g: partners(*v) for g, v in groups.items() if any(v)}
