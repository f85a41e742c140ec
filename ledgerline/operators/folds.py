"""Sequential folds over event logs, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def health_fold(events: DataFrame, key: str, order: list[str], ok: Column, counted: Column, origin: Column, limit: int = 3) -> DataFrame:
    """Running `epoch`, `streak` and `failing` of each key.

    A success begins an epoch. In an epoch, a counted failure adds one to the streak if its origin isn't that of the counted
    failure before it. From `limit` on, the key is failing, until the next success.
    """
    upto = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("epoch", F.sum(F.when(ok, 1).otherwise(0)).over(upto)).withColumn("_origin", F.when(counted, origin))
    within = Window.partitionBy(key, "epoch").orderBy(*order)
    last = F.last("_origin", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    adds = F.when(F.col("_origin").isNotNull() & ~F.col("_origin").eqNullSafe(last), 1).otherwise(0)
    rows = rows.withColumn("_adds", adds)
    rows = rows.withColumn("streak", F.sum("_adds").over(within))
    return rows.withColumn("failing", F.col("streak") >= limit).drop("_origin", "_adds")


def edges(ticks: DataFrame, key: str, order: str, firing: Column) -> DataFrame:
    """Ticks where a rule starts to fire or ceases to, as `edge` (raise, resolve); null `firing` is no decision."""
    rows = ticks.withColumn("_firing", firing).filter("_firing is not null")
    before = F.coalesce(F.lag("_firing").over(Window.partitionBy(key).orderBy(order)), F.lit(False))
    edge = F.when(F.col("_firing") & ~before, "raise").when(~F.col("_firing") & before, "resolve")
    return rows.withColumn("edge", edge).filter("edge is not null").drop("_firing")


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
