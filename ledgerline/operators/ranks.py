"""Nearest-rank percentiles of groups of any size, by way of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key, the values at place round((n - 1) * share) of the ascending positive values, a column per share.

    Values are counted before they are ranked, so what comes together is a histogram, never a group's rows. Keys without positive
    values are absent.
    """
    counted = rows.filter(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda p: F.min(F.when(F.col("_upto") > F.round((F.col("_total") - 1) * F.lit(p)), F.col(value)))
    return ranked.groupBy(*keys).agg(*[at(p).alias(name) for name, p in shares.items()])
