"""Cutting lineage in loops."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Makes Spark delete an action's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """Frames that are made herein delete the shuffle files of their actions when these end."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of spark.checkpoint.dir; a folder of its own only where that is unset and all runs on this machine.

    The shuffle files that led to it are deleted.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    with releasing(df.sparkSession):
        return df.select("*").checkpoint()


def counted(df: DataFrame) -> int:
    """Number of rows; the shuffle files of the count are deleted."""
    with releasing(df.sparkSession):
        return df.count()


#: Most rows and bytes of an Arrow batch that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of this session to a few MB of texts; limits that are lower already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\d+", spark.conf.get(key))
        if now is None or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))
