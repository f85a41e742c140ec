"""Joins that Spark has no operator for: bags with payload, latest row before another, longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], chunk: Column) -> DataFrame:
    """Rows with their place among those of equal keys, as `nth`.

    `chunk` must never fall along `order`: rows are sorted within chunks of a key only, and counts of the chunks before them are added, so
    that a key which most rows share is not sorted in one place.
    """
    parted = rows.withColumn("_chunk", chunk)
    within = [*keys, "_chunk"]
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = parted.groupBy(*within).agg(F.count("*").alias("_n")).select(*within, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return parted.withColumn("_place", place).join(before, within).withColumn("nth", F.col("_before") + F.col("_place")).drop("_chunk", "_place", "_before")


def bag_sides(rows: DataFrame, now: Column, keys: list[str], order: list[Column | str], chunk: Column) -> DataFrame:
    """The difference of two bags that `now` tells apart, as rows with a `side`: new, preexisting (the current row) or fixed.

    Of equal keys, the earliest rows match first. Rows are numbered once and meet by key and number, so no key's rows are ever together.
    """
    placed = numbered(rows.withColumn("_now", now), [*keys, "_now"], order, chunk)
    row = F.struct(*rows.columns)
    met = placed.groupBy(*keys, "nth").agg(F.max(F.when(F.col("_now"), row)).alias("current"), F.max(F.when(~F.col("_now"), row)).alias("baseline"))
    side = F.when(F.col("baseline").isNull(), "new").when(F.col("current").isNull(), "fixed").otherwise("preexisting")
    return met.select(F.coalesce("current", "baseline").alias("row"), side.alias("side")).select("row.*", "side")


def latest_before(rows: DataFrame, keys: list[str], order: list[Column | str], candidate: Column, value: Column) -> Column:
    """The value of the last candidate row strictly before each row, in the given order."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(candidate, value), ignorenulls=True).over(before)


def prefixes(path: Column) -> Column:
    """Every segment-wise prefix of a path, from the empty one to the path itself."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def longest_prefix(rows: DataFrame, path: str, owners: DataFrame, owner: str, key: list[str]) -> DataFrame:
    """Each row with the longest of the owners' paths that is a segment-wise prefix of its own; null if there is none.

    Prefixes are exploded and joined by equality, so the work is linear in the paths' depth.
    """
    spread = rows.select(*key, F.explode(F.array_distinct(prefixes(F.col(path)))).alias("_prefix"))
    best = spread.join(owners.select(F.col(owner).alias("_prefix")).distinct(), "_prefix").groupBy(*key).agg(F.max_by("_prefix", F.length("_prefix")).alias("owner"))
    return rows.join(best, key, "left")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of `left` and `right` (key, from_at, to_at; `right` as r_from and r_to) of a key whose spans overlap, ends not included.

    Spans are filed under every bin of `width` that they reach and met by key and bin, so that a key with many spans is spread over its bins and only spans of
    one time meet. A pair that meets in several bins counts in the one where the later of the two begins. Empty spans overlap nothing.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    l = left.filter("to_at > from_at").withColumn("_bin", bins(F.col("from_at"), F.col("to_at")))  # noqa: E741
    r = right.filter("r_to > r_from").withColumn("_bin", bins(F.col("r_from"), F.col("r_to")))
    both = l.join(r, [key, "_bin"])
    first = F.col("_bin") == F.floor(F.greatest("from_at", "r_from") / width)
    return both.filter((F.col("from_at") < F.col("r_to")) & (F.col("r_from") < F.col("to_at")) & first).drop("_bin")
