"""Incremental scans: new or changed files of a folder as a stream, and what is stale against earlier results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stale(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Sources (name, modified) without a result at least as new."""
    newest = results.groupBy("name").agg(F.max("modified").alias("done"))
    return sources.join(newest, "name", "left").where("done is null or done < modified").drop("done")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, transform):
    """Run transform over every micro-batch of new files and append its rows to a Parquet folder."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    step = lambda batch, _: transform(batch).write.mode("append").parquet(out)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
