"""Filters with optional parameters, and pages in a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def where_given(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal the given values; parameters that are None ask nothing, so they don't reach the plan."""
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """Rows `offset` to `offset + limit` in order; no page is larger than `most`."""
    return rows.orderBy(*order).offset(offset).limit(max(0, min(limit, most)))


def page_per(rows: DataFrame, key: str, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page of each key, with each row's place as `place` and the key's rows as `total`."""
    places = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("total", F.count("*").over(Window.partitionBy(key)))
    return places.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def budget_prefix(rows: DataFrame, key: str, order: list[Column | str], size: Column, budget: int) -> DataFrame:
    """The rows of each key, in order, that fit a budget; the first that doesn't ends the page. `used` is the running size."""
    upto = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("used", F.sum(size).over(upto)).filter(F.col("used") <= budget)
