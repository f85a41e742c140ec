"""Claims of which each depends on the grant before it: a fold over each key's timeline."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import settled


def granted(claims: DataFrame, offline: DataFrame, lease: int, key: str = "key") -> DataFrame:
    """id and granted for all claims (key, id, at, worker); equal times go by id.

    A claim is granted if nothing holds the key: no grant came before it, the last grant is `lease` old, or its worker is offline by then (offline: worker,
    off, until). A claim that is refused changes nothing. Spark sorts each key's claims together with the times when workers who claim that key go offline;
    they are read through once, batch by batch. What is held in between is the last grant, and until when each worker is offline. So the work grows
    with claims and with reports times the keys of their worker, and not with pairs of both.
    """
    held = settled(claims.select(F.col(key).alias("key"), "id", "at", "worker"), "lease-claims")
    pairs = held.select("key", "worker").distinct()
    away = offline.join(pairs, "worker").select("key", F.lit(None).cast(held.schema["id"].dataType).alias("id"), F.col("off").alias("at"), "worker", "until")
    rows = held.withColumn("until", F.lit(None).cast("long")).unionByName(away)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, holder, since, ends = None, None, None, {}
        for b in batches:
            ids, out = [], []
            for k, i, at, worker, until in zip(*[b.column(c).to_pylist() for c in ("key", "id", "at", "worker", "until")], strict=True):
                if now is None or k != now[0]:
                    now, since, ends = (k,), None, {}
                if until is not None:
                    ends[worker] = max(until, ends.get(worker, until))
                    continue
                ok = since is None or at - since >= lease or ends.get(holder, at) > at
                if ok:
                    holder, since = worker, at
                ids.append(i)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), pa.array(out, pa.bool_())], ["id", "granted"])

    # who goes offline at the time of a claim is offline by then
    in_order = rows.repartition("key").sortWithinPartitions("key", "at", F.col("until").isNull(), "id")
    return in_order.mapInArrow(fold, f"id {held.schema['id'].dataType.simpleString()}, granted boolean")
