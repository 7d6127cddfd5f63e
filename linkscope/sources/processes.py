"""Running processes of the machines that Spark's Python workers are on, as a data source `processes`.

A task sees the machine it runs on and no other, and Spark does not say where a task goes, so there are more tasks than
machines and what several of them saw on one machine is made one row.
"""

from __future__ import annotations

import os
import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linkscope.sources.text_tables import mapped_libraries

ROOT = "/proc"


def _text(path: str) -> str | None:
    """A file of a process; None where it ended or may not be read."""
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8", "replace")
    except OSError:
        return None


class ProcessReader(DataSourceReader):
    """Each task lists the processes of its machine; those that end meanwhile, or have no status, are left out."""

    def __init__(self, options: dict[str, str]):
        self.tasks, self.root = int(options.get("tasks", 1)), options.get("root", ROOT)
        self.pid = options.get("pid")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        host = socket.gethostname()
        for pid in [self.pid] if self.pid else sorted(filter(str.isdigit, os.listdir(self.root)), key=int):
            status = _text(f"{self.root}/{pid}/status")
            if status is None:
                continue
            try:
                exe = os.readlink(f"{self.root}/{pid}/exe")
            except OSError:
                exe = None
            yield host, int(pid), exe, _text(f"{self.root}/{pid}/cmdline"), status, _text(f"{self.root}/{pid}/maps")


class Processes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "processes"

    def schema(self) -> str:
        return "host string, pid long, exe string, cmdline string, status string, maps string"

    def reader(self, schema) -> ProcessReader:
        return ProcessReader(self.options)


def running(spark: SparkSession, pid: int | None = None, name: str | None = None, tasks: int | None = None, root: str = ROOT) -> DataFrame:
    """Running processes, one row for each host and pid, of the given pid and name (case counts) if these are given.

    Columns host, pid, name, exe, cmdline, uid, threads, rss_kb, maps.  What may not be read is null, or empty for cmdline; tasks
    should be several times the number of machines, and is Spark's parallelism unless given.
    """
    spark.dataSource.register(Processes)
    reader = spark.read.format("processes").option("tasks", tasks or spark.sparkContext.defaultParallelism).option("root", root)
    raw = (reader if pid is None else reader.option("pid", pid)).load()
    field = lambda key, form: F.nullif(F.regexp_extract("status", rf"(?m)^{key}:[ \t]*({form})", 1), F.lit(""))
    named = F.coalesce(field("Name", r"[^\n]*?(?=[ \t]*$)"), F.element_at(F.split("exe", "/"), -1))
    out = raw.select(
        "host", "pid", named.alias("name"), "exe", F.trim(F.translate(F.coalesce("cmdline", F.lit("")), "\0", " ")).alias("cmdline"),
        field("Uid", r"\d+").cast("long").alias("uid"), field("Threads", r"\d+").cast("long").alias("threads"), field("VmRSS", r"\d+").cast("long").alias("rss_kb"), "maps",
    )
    if name is not None:
        out = out.where(F.col("name") == name)
    return out.dropDuplicates(["host", "pid"])


def libraries_of(found: DataFrame) -> DataFrame:
    """Libraries that processes (host, pid, maps) have mapped: host, pid, path, deleted, position; the first line of a path counts."""
    lines = found.where("maps is not null").select("host", "pid", F.posexplode(F.split("maps", "\n")).alias("position", "line"))
    return mapped_libraries(lines, ["host", "pid"])
