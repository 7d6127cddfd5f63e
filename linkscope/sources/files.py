"""Text files below a folder, of any coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes from the start that are looked at for control characters.
HEAD = 4096


def decoded(content: Column) -> Column:
    """Text of bytes read as UTF-8; what is none becomes U+FFFD, so no file stops a scan."""
    return F.make_valid_utf8(content.cast("string"))


def is_text(content: Column) -> Column:
    """No zero byte anywhere, and few control characters but blanks at the start."""
    whole = F.decode(content, "ISO-8859-1")
    head = F.substring(whole, 1, HEAD)
    controls = F.regexp_count(head, F.lit(r"[\x01-\x08\x0B\x0E-\x1F]"))
    return (F.length(content) == 0) | ((F.instr(whole, "\0") == 0) & (controls <= F.greatest(F.lit(1), F.floor(F.length(head) / 100))))


def texts(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """file, text and size in bytes of the text files below a path, those in hidden folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    below = F.substring_index(F.col("path"), path.rstrip("/"), -1)
    return raw.where(~below.rlike(r"/\.[^/]+/") & is_text(F.col("content"))).select(F.col("path").alias("file"), decoded(F.col("content")).alias("text"), F.col("length").alias("size"))


def rejected(spark: SparkSession, path: str, endings: list[str]) -> DataFrame:
    """file and error of the files that are not scanned: not text, or of an ending that no language has."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    error = F.when(~ending.isin(endings), F.concat(F.lit("Unsupported extension: "), ending)).when(~is_text(F.col("content")), F.concat(F.lit("Not a text file: "), F.col("path")))
    return raw.select(F.col("path").alias("file"), error.alias("error")).where("error is not null")
