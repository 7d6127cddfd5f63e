"""Layers of a drawn graph, and the order of nodes within a layer.

A queue begins with the nodes that nothing leads to.  A node that leaves it puts each node after it one layer below its own, if
that is deeper than where it was, and into the queue if it was never there.  A node that is put deeper after it left
the queue passes nothing on, so a layer is not the longest path, and cycles end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.operators.lineage import cut
from linkscope.operators.ordering import in_turn, numbered


def queue(edges: DataFrame, inner: DataFrame, first: DataFrame, again: bool) -> tuple[DataFrame, DataFrame]:
    """(node, level, turn) of the nodes that ever are in the queue, which gives them out by level and then turn: the first nodes, and those after.

    A level is the least number of hops from a first node; within it a node's turn follows that of the first node that led to it, then its name.
    inner: edges from nodes that something leads to, which are all that levels after the first one need; again: whether something leads to a first node.
    """
    level = 0
    front = begun = in_turn(first, ["node"], "turn").select("node", F.lit(0).cast("long").alias("level"), "turn")
    found = front.limit(0)
    while not front.isEmpty():
        level += 1
        led = (edges if level == 1 else inner).join(front.select(F.col("node").alias("src"), "turn"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("turn").alias("via"))
        met = found.unionByName(begun) if again else found
        front = in_turn(led.join(met.select("node"), "node", "left_anti"), ["via", "node"], "turn").select("node", F.lit(level).cast("long").alias("level"), "turn")
        found = front if level == 1 else found.unionByName(front)
    return begun, found


def passed_on(inner: DataFrame, given: DataFrame) -> DataFrame:
    """(node, taken): the layer that each node of the queue after the first ones has when it leaves it.

    Only edges that lead onward in the queue count for it, and these have no cycles: the longest of their paths,
    by rounds in which the nodes that went deeper tell those after them.  A first node tells 1, and those after it are no higher.
    """
    at = lambda end: given.select(F.col("node").alias(end), F.struct("level", "turn").alias(f"{end}_turn"))
    onward = cut(inner.join(at("src"), "src").join(at("dst"), "dst").where("src_turn < dst_turn").select("src", "dst"))
    taken = given.select("node", F.col("level").alias("taken"))
    news = taken
    while not news.isEmpty():
        told = onward.join(news.select(F.col("node").alias("src"), "taken"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("taken") + 1).alias("told"))
        after = cut(taken.join(told, "node", "left").select("node", F.greatest("taken", "told").alias("taken"), F.coalesce(F.col("told") > F.col("taken"), F.lit(False)).alias("moved")))
        taken, news = after.drop("moved"), after.where("moved").drop("moved")
    return taken


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, layer, place) of all ends of edges (src, dst), and of further nodes (node) if given.

    If something leads to every node the queue begins with the least one; nodes that never are in the queue are in layer 0.
    Place counts from 0 in each layer: by the mean place of the nodes before in the layer above (0 if there are none), then
    by name.  Repeated edges count once; edges with a null end and null nodes are left out; an edge from a node to itself makes it no
    first node.  Levels, rounds and layers take a few small jobs each, over the edges from nodes that something leads to; all edges
    are read for the first level and the first layer only.  No task holds a layer.
    """
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    led = cut(e.select(F.col("dst").alias("node")).distinct())
    inner = cut(e.join(led.select(F.col("node").alias("src")), "src", "left_semi"))
    sources = e.select(F.col("src").alias("node"))
    sources = sources if nodes is None else sources.union(nodes.select("node").where("node is not null"))
    heads = cut(sources.distinct().join(led, "node", "left_anti"))
    again = heads.isEmpty()
    begun, after = queue(e, inner, led.agg(F.min("node").alias("node")).where("node is not null") if again else heads, again)
    taken = passed_on(inner, after)
    telling = taken.unionByName(begun.select("node", F.lit(0).cast("long").alias("taken"))) if again else taken
    told = inner.join(telling.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg((F.max("taken") + 1).alias("told"))
    layered = cut(led.join(taken, "node", "left").join(told, "node", "left").select("node", F.coalesce(F.greatest("taken", "told"), F.lit(0).cast("long")).alias("layer")))
    above, below = layered.select(F.col("node").alias("src"), F.col("layer").alias("above")), layered.select(F.col("node").alias("dst"), "layer")
    near = cut(inner.join(above, "src").join(below, "dst").where("layer = above + 1 and layer > 1").select("src", "dst", "layer"))
    # nodes that nothing leads to are in layer 0, thus next to layer 1 only
    topmost = e.join(below.where("layer = 1"), "dst")
    zero = heads.select("node", F.lit(0).cast("long").alias("layer")).unionByName(layered.where("layer = 0"))
    out = last = numbered(zero, ["node"], "place")
    layer = 0
    # a layer may be empty, and then those of the next have no nodes before them
    while (layer := layered.where(F.col("layer") > layer).agg(F.min("layer")).first()[0]) is not None:
        leading = topmost if layer == 1 else near.where(F.col("layer") == layer)
        mean = leading.join(last.select(F.col("node").alias("src"), "place"), "src").groupBy(F.col("dst").alias("node")).agg((F.sum("place").cast("double") / F.count("*")).alias("mean"))
        rows = layered.where(F.col("layer") == layer).join(mean, "node", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
        last = numbered(rows, ["mean", "node"], "place").select("node", "layer", "place")
        out = out.unionByName(last)
    return out.select("node", "layer", "place")
