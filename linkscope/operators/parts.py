"""Partitions in proportion to the files that a frame is read from."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files for each partition.
PART_BYTES = 8 << 20


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df is read from; no row is read. A checkpoint or rows of the driver have none."""
    jvm, conf, total = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by these columns, over more partitions than the session's where its files are many, so that what one task holds does not grow with them.

    For rows that are exchanged by the columns anyway, as grouping, joins and windows do; a smaller df stays as it is.
    """
    n = -(-file_bytes(df) // PART_BYTES)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def gathered(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by these columns whatever its size, over as many partitions as its files or the session ask for; for rows that Python goes through group by group."""
    there = dealt(df, *by)
    return df.repartition(*by) if there is df else there
