"""Connected components of an edge table, by repeated hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges(a, b); root is the smallest node of its component.

    Each round a node takes the smallest label around it, then its label's label, so chains
    shrink geometrically.  All is joins and map-side combined minima over the edges; lineage is cut each round.  The edges of a
    node, and the nodes of a component, meet where its label is joined: rows of two ids each, which Spark's skew
    join may split.  An edge with a null end, or with the same node at both ends, links nothing.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(around, "node").select("node", "root", F.least("root", "near").alias("low"))
        # the old root learns the smaller label too
        told = hooked.where("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        hooked = hooked.join(told, "node", "left").select("node", F.col("root").alias("was"), F.least("low", "told").alias("low"))
        above = hooked.select(F.col("node").alias("low"), F.col("low").alias("up"))
        after = cut(hooked.join(above, "low", "left").select("node", "was", F.coalesce("up", "low").alias("root")))
        changed = not after.where("was <> root").isEmpty()
        labels = after.select("node", "root")
        if not changed:
            return labels
