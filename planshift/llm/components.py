"""Connected components of a graph of links, as joins over narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planshift.llm.shared import stored


def forest_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` as ``components``, for many overlapping forests ``edges(u, v)`` with a head ``u`` < ``v``.

    Every node points to the least of its heads, and its other heads are linked to that one. Nodes that are nobody's
    head then have the pointer as their only edge, so the rounds of ``components`` see heads alone, whose number does not
    grow with how often a node was met.
    """
    heads = stored(edges.groupBy("v").agg(F.sort_array(F.collect_set("u")).alias("heads")), "heads")
    points = heads.select(F.col("v").alias("node"), F.col("heads")[0].alias("head"))
    several = heads.filter(F.size("heads") > 1).select("heads").distinct()
    links = several.select(F.col("heads")[0].alias("u"), F.explode(F.slice("heads", 2, 1 << 30)).alias("v"))
    above = stored(points.select("head").distinct(), "head-nodes")
    inner = points.join(above.withColumnRenamed("head", "node"), "node", "left_semi")
    tops = components(links.union(inner.select(F.col("head").alias("u"), F.col("node").alias("v"))).distinct())
    tops = tops.select(F.col("node").alias("head"), "label")
    own = above.join(tops, "head", "left").select(F.col("head").alias("node"), F.coalesce("label", "head").alias("label"))
    outer = points.join(above.withColumnRenamed("head", "node"), "node", "left_anti")
    return outer.join(own.withColumnRenamed("node", "head"), "head").select("node", "label").union(own)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for all nodes of ``edges(u, v)``: the label is the smallest node of the component.

    Each round takes the smallest label of a node and its neighbours and then the label of that label, so paths halve;
    labels are stored each round, and the rounds end when no label changes, however many that takes.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels, both.v == labels.node)
            .groupBy("u")
            .agg(F.min("label").alias("near"))
            .select(F.col("u").alias("node"), "near")
        )
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("label").alias("jumped"))
        moved = lower.join(jump, "lower").select("node", "label", F.least("lower", "jumped").alias("next"))
        moved = stored(moved, "labels")
        changed = moved.filter(F.col("label") != F.col("next")).limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
