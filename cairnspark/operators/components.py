"""Connected components of large edge lists by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.storage import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: edges (a, b) with a > b. The smallest neighbour of each node is found by an
    aggregate that starts on the map side, and the join back is one that Spark can split by key."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        out = both.where("b > a").withColumnRenamed("a", "u").join(low, "u").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
        own = edges.withColumnRenamed("a", "u").join(low, "u")
        out = own.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select(F.col("u").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes that have an edge; a component is named by its smallest node.
    ``edges`` has long columns a and b."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = None
    while True:
        edges = materialize(_stars(_stars(edges, True), False), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    own = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return own.union(edges.select(F.col("b"), F.col("b")).distinct())


def nearest_anchors(anchors: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(node, hops, anchor): every node within ``hops`` lines (src, dst, either way) of an anchor (node), with its distance and the
    smallest of the anchors that are that near. All anchors are followed at once: a front holds each node
    it reaches once, whatever number of anchors reach it, and a node that was reached before never again."""
    lines = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).where("node is not null and other is not null").distinct(), "lines")
    front = anchors.where("node is not null").select("node", F.lit(0).alias("hops"), F.col("node").alias("anchor")).distinct()
    found = front = materialize(front, "anchors")
    for hop in range(1, hops + 1):
        step = front.join(lines, "node").groupBy(F.col("other").alias("node")).agg(F.min("anchor").alias("anchor"))
        new = step.join(found.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hops"), "anchor")
        front = materialize(new, "front")
        found = found.union(front)
    return found
