"""Sinks: Parquet, JSON, separated text, workbooks (see workbook), and pages and documents written row by row."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkscope.plans.workbook import column_letter, sheet_names, spreadsheet  # noqa: F401  (sinks too)


def write(df: DataFrame, path: str, kind: str, partition: list[str] | None = None) -> None:
    """Distributed write; kind: parquet, json or tsv."""
    w = df.write.mode("overwrite").partitionBy(*(partition or []))
    if kind == "tsv":
        w.option("sep", "\t").option("header", "true").csv(path)
    elif kind in ("parquet", "json"):
        w.format(kind).save(path)
    else:
        raise ValueError(f"no such sink: {kind}")


# Orders of the tables that commands write; a minus is descending.  What a table lacks is left out.
ORDERS = {
    "call_sites": ["project", "file", "line", "symbol", "caller"],
    "diagnostics": ["file", "line", "column"],
    "recovered": ["file", "line", "column", "symbol"],
    "symbol_summary": ["-n_calls", "symbol"],
    "project_stats": ["-n_symbols", "-n_calls", "project"],
    "blockers": ["project", "-n_calls", "symbol", "status"],
    "by_depth": ["depth"],
    "pairs": ["project", "file", "caller", "symbol", "new_line", "old_line"],
    "libraries": ["host", "pid", "package", "position", "path"],
}


def order_of(name: str, df: DataFrame) -> list:
    """The order of the rows of a table by its name, as sort expressions; none if it has no order."""
    # a partner that is gone counts by the line it had
    own = {"new_line": F.coalesce("new_line", "old_line", F.lit(0)), "old_line": F.coalesce("old_line", F.lit(0))} if name == "pairs" else {}
    kept = [(c, c.removeprefix("-")) for c in ORDERS.get(name, []) if c.removeprefix("-") in df.columns]
    return [own.get(bare, F.col(bare)).desc() if c != bare else own.get(bare, F.col(bare)).asc() for c, bare in kept]


def write_ordered(df: DataFrame, path: str, kind: str, order: list) -> None:
    """As write, but the rows of all files, taken by file name, come in the given order (columns or sort expressions).

    Rows go to ranges of the order and are sorted there, so no task holds all.  Beside the files a folder _parts lists
    them in order, with each one's first row (from 0) and number of rows; readers of the table do not see it.  Rows that tie come in any order.
    """
    write(df.repartitionByRange(*order).sortWithinPartitions(*order), path, kind)
    parts = _parts(df.sparkSession, path, kind, df.schema).groupBy("file").agg(F.count("*").alias("n_rows"))
    # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    listed = parts.select("file", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_row"), "n_rows")
    listed.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_parts")


def _parts(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """The file name of each row of a written table."""
    reader = spark.read.schema(schema)
    if kind == "tsv":
        # texts may hold line ends
        reader = reader.option("sep", "\t").option("header", "true").option("multiLine", "true").format("csv")
    else:
        reader = reader.format(kind)
    return reader.load(path).select(F.col("_metadata.file_name").alias("file"))


def read_ordered(spark: SparkSession, path: str, into: str = "row") -> DataFrame:
    """The Parquet table that write_ordered wrote, with each row's place in the order, from 0; nothing is sorted."""
    listed = spark.read.schema("file string, first_row long, n_rows long").json(f"{path.rstrip('/')}/_parts")
    table = spark.read.parquet(path)
    kept = [table[c] for c in table.columns]
    placed = table.select(*kept, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return placed.join(F.broadcast(listed.select(F.col("file").alias("_file"), "first_row")), "_file").select(*table.columns, (F.col("first_row") + F.col("_at")).alias(into))


def page(path: str, title: str, tables: dict[str, DataFrame]) -> None:
    """A self-contained page of all rows of each table, streamed row by row."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>")
        for name, df in tables.items():
            f.write(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
            for row in df.toLocalIterator():
                f.write("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in row) + "</tr>")
            f.write("</table>")


def document(path: str, parts: dict) -> None:
    """One JSON object: plain values as they are, a table as the list of its rows, streamed row by row."""
    with open(path, "w", encoding="utf-8") as f:
        for i, (name, value) in enumerate(parts.items()):
            f.write(("{" if i == 0 else ",\n") + json.dumps(name) + ": ")
            if isinstance(value, DataFrame):
                f.write("[")
                for j, row in enumerate(value.select(F.to_json(F.struct("*"))).toLocalIterator()):
                    f.write((",\n" if j else "") + row[0])
                f.write("]")
            else:
                json.dump(value, f, ensure_ascii=False, default=str)
        f.write("}" if parts else "{}")
