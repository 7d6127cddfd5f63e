"""Workbooks written by tasks, read back."""

import glob
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from linkscope.plans import workbook
from linkscope.sources.reports import sheets


def read(path) -> dict[str, list[list]]:
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
    with open(path, "rb") as f:
        return dict(sheets(f.read()))


@pytest.mark.parametrize("sizes", [(0, 0), (1, 0), (0, 7), (5, 1), (70000, 3), (3, 70001)])
def test_checksums_join(sizes):
    a, b = (bytes(i * 31 % 251 for i in range(n)) for n in sizes)
    assert workbook.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_rows_in_order_over_sheets_and_blocks(spark, tmp_path, monkeypatch):
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t")).repartition(7).orderBy(F.desc("id"))
    workbook.spreadsheet(str(tmp_path / "w.xlsx"), {"all": rows}, rows=64)
    found = read(tmp_path / "w.xlsx")
    assert list(found)[:2] == ["all", "all (2)"] and all(s[0] == ["id", "t"] and len(s) <= 65 for s in found.values())
    assert [r for s in found.values() for r in s[1:]] == [[str(i), f"t{i}"] for i in reversed(range(1000))]
    monkeypatch.setattr(workbook, "BLOCK", 10)
    workbook.spreadsheet(str(tmp_path / "b.xlsx"), {"all": rows})
    assert read(tmp_path / "b.xlsx")["all"][1:] == [[str(i), f"t{i}"] for i in reversed(range(1000))]
    assert sorted(glob.glob(f"{tmp_path}/*")) == [str(tmp_path / "b.xlsx"), str(tmp_path / "w.xlsx")]


def test_odd_values(spark, tmp_path):
    rows = spark.createDataFrame([(None, "", float("nan"), True, ["x"]), ("=a<&>\x00\x1fb", "two\nlines", -1.5, None, None)], "`=h` string, x string, n double, b boolean, l array<string>").coalesce(1)
    same = rows.select("x", "x")
    workbook.spreadsheet(f"file://{tmp_path}/w.xlsx", {"a/b": rows, 'q"<': same, "none": workbook.Sheet(rows.limit(0), widths=[3, 4]), "bare": workbook.Sheet(rows.select("x"), head=False)})
    found = read(tmp_path / "w.xlsx")
    assert found["a_b"][0] == ["'=h", "x", "n", "b", "l"] and found["a_b"][1:] == [[None, "", "nan", "True", "['x']"], ["'=a<&>b", "two\nlines", "-1.5", None, None]]
    assert found['q"<'][0] == ["x", "x"] and len(found["none"]) == 1 and found["bare"] == [[""], ["two\nlines"]]
    with pytest.raises(ValueError):
        workbook.spreadsheet(str(tmp_path / "x.xlsx"), {})


def test_what_fails_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception, match="no"):
        workbook.spreadsheet(str(tmp_path / "w.xlsx"), {"a": spark.range(3), "b": bad})
    assert not glob.glob(f"{tmp_path}/*")


def test_no_row_on_the_driver(spark, tmp_path, monkeypatch):
    rows = spark.range(5)
    for name in ("collect", "toLocalIterator", "toPandas", "take", "head", "first"):
        monkeypatch.setattr(type(rows), name, lambda *_, **__: pytest.fail("rows came to the driver"))
    workbook.spreadsheet(str(tmp_path / "w.xlsx"), {"a": rows})
    assert len(read(tmp_path / "w.xlsx")["a"]) == 6
