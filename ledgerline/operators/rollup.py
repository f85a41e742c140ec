"""Rollups of (sum, count) points: minutes out of samples, longer buckets out of minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket
from ..sources.telemetry import as_of


def minute_points(tasks: DataFrame, now: Column | None = None) -> DataFrame:
    """metric, bucket, sum and count of every minute before the one in progress: that of `now`, or else of the latest task."""
    now = as_of(tasks, "at_s") if now is None else now
    points = tasks.withColumn("bucket", bucket(F.col("at_s"), 60)).filter(F.col("bucket") < now - now % 60)
    return points.groupBy(F.col("event_type").alias("metric"), "bucket").agg(F.sum("k").cast("double").alias("sum"), F.count("*").alias("count"))


def fold(points: DataFrame, width: int) -> DataFrame:
    """Points added up in wider buckets; writing a point twice into one bucket adds both."""
    return points.groupBy("metric", bucket(F.col("bucket"), width).alias("bucket")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
