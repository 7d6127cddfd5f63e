"""The first paths from each node to a target, breadth first, without listing the others.

Walks backwards from the targets tell for each node the numbers of hops in which it can reach one, as bits of a mask.
Prefixes then grow forwards a hop a level, all sources at once, and a prefix is kept for a length of the whole path if its
tip can still make it and if it is among the first that can.  A path of a given length is sure to be among the first
ones where it comes before the least prefix that was left out for that length.  On a graph without cycles each kept prefix
leads to a path, so a number of prefixes is enough for as many paths; in cycles a prefix may have no way but through
itself, and a source that has come to a gap is searched again with more prefixes, until no source has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope.operators.lineage import cut

#: Factor by which a source with a gap gets more prefixes.
MORE = 8


def lengths(hop: DataFrame, goal: DataFrame, depth: int) -> DataFrame:
    """node and mask: bit i is set if a walk of i hops leads to a target and no target is on the way."""
    front, out = goal.select("node"), goal.select("node", F.lit(1).cast("long").alias("mask"))
    for i in range(1, depth + 1):
        front = cut(hop.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct())
        if front.isEmpty():
            break
        out = out.unionByName(front.select("node", F.lit(1 << i).cast("long").alias("mask")))
    return cut(out.groupBy("node").agg(F.bit_or("mask").alias("mask")))


def searched(hop: DataFrame, mask: DataFrame, sources: DataFrame, n: int, depth: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """Paths (src, path, depth) that are sure to come next after those before them, and the sources with a gap before n paths."""
    spark = hop.sparkSession
    front = sources.select(F.col("node").alias("src"), F.array("node").alias("path"), F.col("node").alias("tip"))
    steps, tips = hop.withColumnRenamed("src", "tip"), mask.withColumnRenamed("node", "dst")
    sure, cuts, have = None, None, None
    for level in range(1, depth + 1):
        longer = front.join(steps, "tip").where(~F.array_contains("path", F.col("dst"))).join(tips, "dst")
        at = F.expr(f"filter(sequence({level}, {depth}), d -> shiftright(mask, d - {level}) & 1 = 1)")
        reached = longer.select("src", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("tip"), F.explode(at).alias("depth"))
        place = F.row_number().over(Window.partitionBy("src", "depth").orderBy("path"))
        ranked = cut(reached.withColumn("place", place).where(F.col("place") <= keep + 1))
        if ranked.isEmpty():
            break
        # the least prefix left out for each length, on this level or before
        here = ranked.where(F.col("place") > keep).groupBy("src", "depth").agg(F.min("path").alias("out"))
        cuts = cut(here if cuts is None else cuts.unionByName(here).groupBy("src", "depth").agg(F.min("out").alias("out")))
        now = cuts.where(F.col("depth") == level).select("src", "out")
        ended = ranked.where((F.col("depth") == level) & (F.col("place") <= keep)).join(now, "src", "left").where(F.col("out").isNull() | (F.col("path") < F.col("out"))).select("src", "path", F.lit(level).cast("long").alias("depth"))
        sure = ended if sure is None else sure.unionByName(ended)
        counted = ended.groupBy("src").agg(F.count("*").alias("n")).join(now.select("src", F.lit(True).alias("short")), "src", "full_outer").select("src", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("short", F.lit(False)).alias("short"))
        if have is not None:
            counted = counted.join(have.select("src", F.col("n").alias("before")), "src", "full_outer").select("src", (F.coalesce("n", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("n"), F.coalesce("short", F.lit(False)).alias("short"))
        have = cut(counted)
        stopped = have.where((F.col("n") >= n) | F.col("short")).select("src")
        front = cut(ranked.where((F.col("depth") > level) & (F.col("place") <= keep)).select("src", "path", "tip").distinct().join(stopped, "src", "left_anti"))
        if front.isEmpty():
            break
    if sure is None:
        kind = sources.schema["node"].dataType.simpleString()
        return spark.createDataFrame([], f"src {kind}, path array<{kind}>, depth long"), sources.limit(0)
    # a prefix was left out that may have led to one of the first n
    full = have.where(F.col("n") >= n).select("src")
    return sure, cut(cuts.select("src").distinct().join(full, "src", "left_anti").select(F.col("src").alias("node")))


def first_paths_to(edges: DataFrame, targets: DataFrame, n: int = 50, depth: int = 10, keep: int | None = None) -> DataFrame:
    """The first n simple paths (src, path, depth, rank) from every node to its first target, shorter ones first, then by their nodes.

    At most depth hops; edges (src, dst) may repeat, loops and nulls are no hops; targets are no sources.
    """
    goal = cut(targets.select("node").where("node is not null").distinct())
    hop = cut(edges.select("src", "dst").where("src <> dst").distinct().join(goal.withColumnRenamed("node", "src"), "src", "left_anti"))
    # each level reads all edges again, so those that lead nowhere go first, and for the search those whose end reaches no target
    ends = hop.select(F.col("src").alias("dst")).union(goal.select(F.col("node").alias("dst"))).distinct()
    hop = cut(hop.join(ends, "dst", "left_semi"))
    mask = lengths(hop, goal, depth)
    hop = cut(hop.join(mask.select(F.col("node").alias("dst")), "dst", "left_semi"))
    todo, keep, out = mask.where("mask > 1").select("node"), keep or n, None
    while True:
        found, gaps = searched(hop, mask, todo, n, depth, keep)
        found = found.join(gaps.withColumnRenamed("node", "src"), "src", "left_anti")
        out = found if out is None else out.unionByName(found)
        if gaps.isEmpty():
            break
        todo, keep = gaps, keep * MORE
    rank = F.row_number().over(Window.partitionBy("src").orderBy("depth", "path")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= n)
