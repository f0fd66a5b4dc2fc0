"""Connected components of a graph in DataFrame rounds, by large-star and small-star steps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise


#: Edges that are worth a task of their own.
EDGES_A_TASK = 50_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """``edges``: distinct (u, v), u > v. Links what a node sees to the least of it: greater neighbours in a large star, else lesser ones and the node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if not small else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if small:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component: the least node reachable) of every node of ``edges`` (u, v: long). Rounds end when nothing changes; their number grows
    with the logarithm of the longest chain. Self-loops and repeated edges are allowed; no edges give an empty result. Nothing but two sums gets to the driver.
    With ``most``, an error if so many rounds don't end it."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    tasks, mark = 1 + now.count() // EDGES_A_TASK, None  # a step has no more edges than nodes and edges at first
    for k in count():
        if k == most:
            raise RuntimeError(f"components are not settled after {most} rounds")
        large = materialise(_star(now, False).coalesce(tasks), "large")
        now = materialise(_star(large, True).coalesce(tasks), "small")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("s")).first()
        if mark == (row["n"], row["s"]):
            break
        mark = (row["n"], row["s"])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
