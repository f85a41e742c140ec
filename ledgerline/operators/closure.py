"""What roots reach in a bounded number of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stores import settled


def closure(roots: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """root, node and depth (the fewest steps) of everything within `steps` of each root; edges have src and dst.

    Each step joins what the one before found for the first time, and leaves out what was found already. Steps are written down, so each is
    worked out once and the plan of a step is one join, however many went before; the walk ends when a step finds nothing.
    """
    ways = settled(edges.select("src", "dst"), "closure-edges")
    front = settled(roots.select("root", F.col("root").alias("node")).distinct(), "closure-0")
    found = front.withColumn("depth", F.lit(0))
    for depth in range(1, steps + 1):
        ahead = front.join(ways, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        front = settled(ahead.join(found.select("root", "node"), ["root", "node"], "left_anti"), f"closure-{depth}")
        if front.isEmpty():
            break
        found = found.unionByName(front.withColumn("depth", F.lit(depth)))
    return found


def settled_closure(roots: DataFrame, edges: DataFrame, steps: int, failed: Column) -> DataFrame:
    """root, node, depth and complete: what each root reaches, or one row without a node where that can't be told in full.

    It can't where a node that is reached has `failed` (a test on `node`), or where the steps don't lead to an end.
    """
    reached = closure(roots, edges, steps + 1)
    bad = failed | (F.col("depth") > steps)
    whole = reached.groupBy("root").agg(F.max(bad).alias("bad"))
    rows = reached.join(whole.filter("NOT bad").select("root"), "root", "left_semi").select("root", "node", "depth", F.lit(True).alias("complete"))
    types = {f.name: f.dataType for f in reached.schema.fields}
    none = whole.filter("bad").select("root", F.lit(None).cast(types["node"]).alias("node"), F.lit(None).cast(types["depth"]).alias("depth"), F.lit(False).alias("complete"))
    return rows.unionByName(none)
