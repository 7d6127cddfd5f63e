"""Joins of names by their beginnings, as equi-joins on the lengths that occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.functions.text import basename


#: Beginnings that a task makes.
MOST_HEADS = 1 << 20


def heads(name: Column, lengths: list[int]) -> Column:
    """The beginnings of a name of the given lengths, as rows; as many at most as a name has characters."""
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(name)) if lengths else F.expr("cast(array() as array<int>)")
    return F.explode(F.transform(fits, lambda n: F.substring(name, F.lit(1), n)))


def lengths_of(names: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in names.select(F.length(column)).where(F.length(column) > 0).distinct().collect())


def first_by_prefix(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """path of each distinct node with the file that stands for it, null where none does.

    files: path and ord.  A file of the same path comes first; else the first in order whose base name begins with the
    node's, or with whose name up to `.so` and that ending the node's begins.  Only the first file of each beginning is kept
    before the join, so a beginning that many share costs a partial aggregate.  The driver holds the lengths that occur.
    """
    own = nodes.select("path").where("path is not null").distinct().withColumn("base", basename(F.col("path")))
    bases = own.select("base").where("base <> ''").distinct()
    known = files.where("path is not null").select("path", "ord", basename(F.col("path")).alias("name"))
    known = known.withColumn("stem", F.concat(F.substring_index("name", ".so", 1), F.lit(".so")))
    lengths = lengths_of(bases, "base")
    # each name becomes as many rows as there are lengths, so a few MB of names would be the work of one task
    n = -(-known.count() * max(1, len(lengths)) // MOST_HEADS)
    wide = known.repartition(n, "path") if n > 1 else known
    first = F.min(F.struct("ord", "path")).alias("first")
    longer = wide.select("ord", "path", heads(F.col("name"), lengths).alias("base")).groupBy("base").agg(first)
    stems = known.groupBy("stem").agg(first)
    shorter = bases.select("base", heads(F.col("base"), lengths_of(stems, "stem")).alias("stem")).join(stems, "stem").groupBy("base").agg(F.min("first").alias("first"))
    met = bases.join(longer.withColumnRenamed("first", "a"), "base", "left").join(shorter.withColumnRenamed("first", "b"), "base", "left").select("base", F.least("a", "b").alias("first"))
    same = known.select("path").distinct().withColumn("same", F.col("path"))
    return own.join(same, "path", "left").join(met, "base", "left").select("path", F.coalesce("same", "first.path").alias("file"))
