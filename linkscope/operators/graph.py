"""Dependency graphs: reachability, simple paths, chains, depths, and project boundaries.

Edges are (src, dst).  Walks go level by level with a bound on the depth, all sources at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkscope.operators.lineage import cut
from linkscope.operators.parts import dealt


def paths_to(edges: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """Simple paths (src, path, depth) from every node that end at their first target, of at most so many hops."""
    # from the targets backwards, so each row of a level is a path that counts; levels are written to the checkpoint folder
    goal = targets.select("node").distinct()
    hop = cut(edges.select("src", "dst").distinct().join(goal.withColumnRenamed("node", "src"), "src", "left_anti"))
    back = hop.select(F.col("src").alias("before"), F.col("dst").alias("src"))
    front = out = cut(hop.join(goal.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", F.array("src", "dst").alias("path"), F.lit(1).cast("long").alias("depth")))
    for _ in range(depth - 1):
        front = cut(front.join(back, "src").where(~F.array_contains("path", F.col("before"))).select(F.col("before").alias("src"), F.concat(F.array("before"), "path").alias("path"), (F.col("depth") + 1).alias("depth")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.select("src", "path", "depth")


def reachable(edges: DataFrame, targets: DataFrame, depth: int = 10) -> DataFrame:
    """Nodes from which a target can be reached in at most so many hops, with the least number; from the targets backwards."""
    # each level is written to the checkpoint folder, so a level's plan does not hold those before it
    front = found = targets.select("node", F.lit(0).cast("long").alias("depth")).distinct()
    back = edges.select(F.col("dst").alias("node"), "src").distinct()
    for i in range(1, depth + 1):
        front = cut(front.join(back, "node").select(F.col("src").alias("node")).distinct().join(found.select("node"), "node", "left_anti").select("node", F.lit(i).cast("long").alias("depth")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def first_paths(paths: DataFrame, n: int = 50) -> DataFrame:
    """The first n paths of each source, shorter ones first, then by their nodes."""
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("depth", "path")).cast("long")).where(F.col("rank") <= n)


def chains(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """Import chains as text for every symbol of the source."""
    return paths.join(symbols, "src").select("src", "symbol", F.array_join(F.transform("path", lambda x: x.cast("string")), " -> ").alias("chain"), "depth")


def by_depth(paths: DataFrame, symbols: DataFrame, names: bool = False) -> DataFrame:
    """Distinct symbols and files at each least depth, and the symbols themselves on demand."""
    low = paths.groupBy("src").agg(F.min("depth").alias("depth"))
    at = low.join(symbols, "src")
    counted = at.groupBy("depth").agg(F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("src").alias("n_files"))
    if not names:
        return counted
    return counted.join(at.select("depth", "symbol").distinct().groupBy("depth").agg(F.array_sort(F.collect_list("symbol")).alias("symbols")), "depth")


def stats(edges: DataFrame) -> DataFrame:
    e = edges.distinct()
    # dealt like the edges, else a task's share of the nodes grows with the files
    nodes = dealt(e.select("src").union(e.select("dst")), "src").distinct()
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(e.agg(F.count("*").alias("n_edges")))


def fans(edges: DataFrame) -> DataFrame:
    """In- and out-degree of every node."""
    e = edges.distinct()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def chain_edges(paths: DataFrame) -> DataFrame:
    """Distinct consecutive pairs of all paths."""
    pair = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    return paths.select(F.explode(pair).alias("e")).select("e.*").distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def boundaries(matched: DataFrame) -> DataFrame:
    """Project folders: for each top-level folder the deepest common ancestor of its matched ones, and the root if it matches itself.

    The common start of the least and greatest path is that of all, so one aggregate is enough.
    """
    parts = matched.select(F.split("path", "/").alias("p"))
    ends = parts.groupBy(F.element_at("p", 1).alias("top")).agg(F.min("p").alias("a"), F.max("p").alias("b"))
    upto = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: ~F.get("a", i - 1).eqNullSafe(F.get("b", i - 1)))), F.size("a") + 1)
    return ends.select("top", F.array_join(F.slice("a", 1, upto - 1), "/").alias("project"))
