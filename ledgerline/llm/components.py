"""Connected components of a graph of links, by alternating large and small stars.

Each round joins every node's neighbours to the smallest of them. Minima are taken by aggregation; those of nodes with more than HUB links are
broadcast, so such a node's links stay where they are, and others are joined by node. Rounds are written to the shared folder; the
loop ends when one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled

#: Links of a node beyond which its minimum is broadcast: at most one row for so many links, 24 bytes each.
HUB = 20_000


def _with_least(ends: DataFrame, least: DataFrame) -> DataFrame:
    """ends (u, v) with the minimum m of u; no task gets more than HUB rows of a node from the join, however many links it has."""
    hubs = F.broadcast(least.filter(F.col("n") > HUB).select(F.col("u").alias("_u"), F.col("m").alias("_m")))
    marked = ends.join(hubs, F.col("u") == F.col("_u"), "left")
    rest = marked.filter("_u IS NULL").select("u", "v").join(least.filter(F.col("n") <= HUB).select("u", "m"), "u")
    return marked.filter("_u IS NOT NULL").select("u", "v", F.col("_m").alias("m")).unionByName(rest)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: link larger neighbours to a node's minimum; else link a node and its smaller neighbours to that minimum."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        out = _with_least(both.filter("v > u"), least).select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = _with_least(down, least).select(F.col("v").alias("b"), F.col("m").alias("a")).unionAll(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.filter("a <> b").select("a", "b").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that links reach) for every node of `links` (columns a and b, any ordered type) but roots.

    Direction, repeats and links of a node to itself don't matter. No links give no rows.
    """
    start = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    held = Settled(start, "links")
    sign = _sign(held.df)
    while sign[0]:
        # one round: a large star, then a small one
        after = Settled(_star(_star(held.df, True), False), "links")
        held.drop()
        held, before, sign = after, sign, _sign(after.df)
        if sign == before:
            break
    return held.df.select(F.col("b").alias("node"), F.col("a").alias("root"))
