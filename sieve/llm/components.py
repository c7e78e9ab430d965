"""Connected components of a large link table, with DataFrame operations only.

Each round hooks every node to its smallest neighbour if that is smaller than
itself, resolves the resulting forest to roots by doubling the pointers, and
replaces the ends of each link by their roots; links inside one root vanish, so
the table shrinks from round to round.  The forest's steps are kept and composed
at the end.  Tables between the steps are reliable checkpoints.  Minima are
pre-aggregated before their shuffle, and joins on a popular root are inner or
left joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _roots(parent: DataFrame) -> DataFrame:
    """(node, up) with ``up`` the root of each node; a root has no row."""
    while True:
        jump = parent.select(F.col("node").alias("_n"), F.col("up").alias("_top"))
        # a stop after two jumps each round: half the tables of single doubling
        once = parent.join(jump, parent["up"] == jump["_n"], "left")
        parent = cut_lineage(once.select("node", F.coalesce("_top", "up").alias("up"), F.col("_top").isNotNull().alias("_moved")))
        if parent.filter("_moved").isEmpty():
            return parent.drop("_moved")
        parent = parent.drop("_moved")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its
    smallest node.  Links may repeat, point either way, or join a node to itself;
    links with a null end are ignored."""
    a, b = links.columns[:2]
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    left = cut_lineage(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low, high).distinct())
    seen = left.select(F.col("a").alias("node")).union(left.select(F.col("b"))).distinct()
    up = None  # (node, component) of all nodes that have been hooked
    while not left.isEmpty():
        roots = _roots(cut_lineage(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))))
        if up is None:
            up = roots
        else:
            step = roots.select(F.col("node").alias("_n"), F.col("up").alias("_top"))
            older = up.join(step, up["up"] == step["_n"], "left").select("node", F.coalesce("_top", "up").alias("up"))
            up = cut_lineage(older.unionByName(roots))
        ra, rb = (roots.select(F.col("node").alias(f"_{x}"), F.col("up").alias(f"_r{x}")) for x in "ab")
        # b always has a root row; a has one only if it was hooked too
        moved = left.join(rb, left["b"] == rb["_b"]).join(ra, F.col("a") == ra["_a"], "left")
        ends = moved.select(F.coalesce("_ra", "a").alias("x"), F.col("_rb").alias("y")).filter("x != y")
        left = cut_lineage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if up is None:
        return seen.withColumn("component", F.col("node"))
    return seen.join(up, "node", "left").select("node", F.coalesce("up", "node").alias("component"))
