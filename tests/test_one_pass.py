"""Scans read their files once, and a symbol's category is found among few prefixes."""

import random

import pytest
from pyspark.sql import functions as F

from linkscope.functions import categories, text
from linkscope.operators import classify, scan
from linkscope.plans import registry, scans  # noqa: F401  (these add their queries to the registry)


def scanned(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("name, most", [("scan_roll_up", 1), ("scan_file_totals", 2)])
def test_files_are_read_once(spark, sf_dir, name, most):
    assert scanned(registry.QUERIES[name](spark, sf_dir)) <= most


def test_totals_of_no_files_and_of_null_names(spark):
    results = spark.createDataFrame([(True, False, ["a", None, "a"], ["x", None], [])], "is_static boolean, uses_dlopen boolean, symbols array<string>, dlsym array<string>, dlopen_libs array<string>")
    machines = spark.createDataFrame([("p", "m", 1)], "path string, arch string, position long")
    assert scan.totals(results, machines).first() == (1, 1, 3, 1, "m")
    assert scan.totals(results.limit(0), machines.limit(0)).first() == (0, 0, 0, 0, "unknown")
    assert scan.roll_up(results).first() == (1, 0, 2, "x", 0, "")
    assert scan.roll_up(results.limit(0)).first() == (0, 0, 0, "", 0, "")


def test_first_category_that_fits(spark):
    r = random.Random(3)
    every = [p for prefixes in categories.PREFIXES.values() for p in prefixes]
    symbols = [*every, *[p[:-1] for p in every], *[p + r.choice(["x", "", "é", "_"]) for p in every], *["".join(r.choices("ABCDEHMNSX_15id", k=r.randint(0, 6))) for _ in range(500)], "é", "", "~"]
    plain = lambda s, rules: next((name for name, prefixes in rules.items() if any(s.startswith(p) for p in prefixes)), "other")
    odd = {"a": ["abc", "x"], "b": ["ab", "", "zz"], "c": ["abcd", "y"]}
    rows = spark.createDataFrame([(s,) for s in symbols], "s string").select("s", categories.category_of(F.col("s")).alias("c"), categories.category_of(F.col("s"), odd).alias("o"), text.basename(F.col("s")).alias("n")).collect()
    assert [(x.c, x.o) for x in rows] == [(plain(x.s, categories.PREFIXES), plain(x.s, odd)) for x in rows]




def test_packages_are_dealt_once_and_summed_up_where_they_lie(spark, sf_dir):
    plan = registry.QUERIES["package_methods"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and scanned(registry.QUERIES["package_methods"](spark, sf_dir)) <= 3


def test_release_of_packages_with_odd_rows(spark):
    """A package in two releases, one that is bundled only, one with no list at all, and a library without a name."""
    kind = "package string, path string, symbols array<string>, dlsym array<string>, dlopen_libs array<string>, libs array<string>, deps array<string>, is_static boolean, uses_dlopen boolean, confidence string"
    files = [("a", "x/liba.so", ["s"], [], [], ["libssl.so.3"], [], False, False, None), ("b", "y/libb.so", ["s"], None, None, None, None, True, None, "high"), ("c", "z/libc.so", None, None, None, None, None, None, None, None), ("d", "libd.so", ["t"], [], [], [], ["q/libb.so"], False, False, None)]
    bundled = spark.createDataFrame([("b", "lib/libssl.so.1"), ("only", "libssl.so"), ("c", None)], "package string, library string")
    releases = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("d", "r1"), ("a", "r2"), ("c", "r3")], "package string, release string")
    out = {r.package: (r.method, r.kind, r.n_symbols) for r in classify.in_release(spark.createDataFrame(files, kind), bundled, releases).collect()}
    assert out == {"a": ("Dynamic", "In-APP-Link", 1), "b": ("Static", "Self-Contained", 1), "c": ("None", "No-OpenSSL", 0), "d": ("Dynamic", "In-APP-Link", 1)}
