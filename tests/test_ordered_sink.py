"""Tables whose files hold the rows in order."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from linkscope import __main__ as command
from linkscope.plans import sinks

ROWS = [(None if i % 97 == 0 else f"f{i * 7919 % 50:02}.c", i % 40, i) for i in range(3000)]


@pytest.fixture
def many(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = ROWS.copy()
    random.Random(1).shuffle(rows)
    yield spark.createDataFrame(rows, "file string, line int, id int").repartition(5)
    for k, v in kept.items():
        spark.conf.set(k, v)


def expected():
    return [r[2] for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))]


@pytest.mark.parametrize("kind", ["parquet", "json", "tsv"])
def test_files_in_order(spark, many, tmp_path, kind):
    path = str(tmp_path / "t")
    sinks.write_ordered(many, path, kind, ["file", F.desc("line"), "id"])
    listed = sorted((json.loads(x) for p in glob.glob(path + "/_parts/*.json") for x in open(p)), key=lambda r: r["file"])
    assert len(listed) > 2 and [r["first_row"] for r in listed] == [sum(r["n_rows"] for r in listed[:i]) for i in range(len(listed))]
    seen = []
    for r in listed:
        if kind == "parquet":
            seen += [x.id for x in spark.read.parquet(f"{path}/{r['file']}").coalesce(1).collect()]
        else:
            lines = open(f"{path}/{r['file']}").read().splitlines()
            seen += [json.loads(x)["id"] for x in lines] if kind == "json" else [int(x.split("\t")[2]) for x in lines[1:]]
    assert seen == expected()
    if kind == "parquet":
        assert [x.id for x in sorted(sinks.read_ordered(spark, path).collect(), key=lambda x: x["row"])] == expected()
        assert sorted(x["row"] for x in sinks.read_ordered(spark, path).collect()) == list(range(len(ROWS)))
        assert spark.read.parquet(path).columns == ["file", "line", "id"]


def test_empty_table(spark, many, tmp_path):
    sinks.write_ordered(many.where("id < 0"), str(tmp_path / "t"), "parquet", ["file"])
    assert sinks.read_ordered(spark, str(tmp_path / "t")).count() == 0


def test_orders_of_tables(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name in "ba":
        (tmp_path / "src" / f"{name}.c").write_text("int f(int x) {\n SSL_new(x);\n return SSL_free(x) + SSL_new(x);\n}\n")
    (tmp_path / "names.txt").write_text("SSL_new\nSSL_free\n")
    assert command.main(["source", str(tmp_path / "src"), "--symbols", str(tmp_path / "names.txt"), "-o", str(tmp_path / "out")], spark) == 0
    rows = sorted(sinks.read_ordered(spark, str(tmp_path / "out" / "call_sites")).collect(), key=lambda r: r["row"])
    assert [(r.file[-3:], r.line, r.symbol) for r in rows] == [(f, *c) for f in ("a.c", "b.c") for c in ((2, "SSL_new"), (3, "SSL_free"), (3, "SSL_new"))]
    blockers = spark.createDataFrame([("p", "a", 1), ("o", "c", 1), ("p", "b", 5)], "project string, symbol string, n_calls long")
    assert [r.symbol for r in blockers.orderBy(*sinks.order_of("blockers", blockers)).collect()] == ["c", "b", "a"]
