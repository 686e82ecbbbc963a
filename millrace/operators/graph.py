"""Reachability over edge tables: closures, ancestors, common parents, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def reach(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, node, depth: what each seed reaches along ``edges`` (src, dst), at its least depth; cycles are harmless.

    Breadth first: a step joins the last frontier with the edges and leaves out what is known; steps are written out.
    """
    known = frontier = materialize(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(known.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionAll(frontier)
    return known


def ancestors(tree: DataFrame, node: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """node, ancestor, depth (0: itself) for all nodes of a parent table; a root is its own parent or has none."""
    edges = tree.where(F.col(parent).isNotNull() & (F.col(node) != F.col(parent))).select(F.col(node).alias("src"), F.col(parent).alias("dst"))
    return reach(tree.select(F.col(node).alias("seed")), edges, max_depth).select(F.col("seed").alias("node"), F.col("node").alias("ancestor"), "depth")


def common_parent(closure: DataFrame, members: DataFrame, key: str, node: str) -> DataFrame:
    """Per ``key`` of ``members`` the deepest node that is an ancestor of all its nodes (ties: the smallest)."""
    level = closure.groupBy("node").agg(F.max("depth").alias("level"))
    size = members.select(key, node).distinct().groupBy(key).agg(F.count("*").alias("size"))
    up = members.select(key, F.col(node).alias("node")).distinct().join(closure, "node").groupBy(key, "ancestor").agg(F.count_distinct("node").alias("n"))
    shared = up.join(size, key).where("n = size").join(level.withColumnRenamed("node", "ancestor"), "ancestor")
    return shared.groupBy(key).agg(F.max_by("ancestor", F.struct("level", -F.col("ancestor"))).alias("common_parent"))


def roll_up(closure: DataFrame, counts: DataFrame, node: str, value: str) -> DataFrame:
    """ancestor, total, pct, n_min, n_max, n_mean, n_sd of ``value`` over all nodes below each (itself included)."""
    below = closure.join(counts.select(F.col(node).alias("node"), F.col(value).alias("v")), "node")
    total = counts.agg(F.sum(value).alias("all"))
    by = below.groupBy("ancestor").agg(F.sum("v").alias("total"), F.min("v").alias("n_min"), F.max("v").alias("n_max"), F.avg("v").alias("n_mean"), F.stddev_pop("v").alias("n_sd"))
    return by.crossJoin(F.broadcast(total)).withColumn("pct", F.col("total") * 100.0 / F.col("all")).drop("all")
