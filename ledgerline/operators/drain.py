"""A greedy drain of a queue, where each assignment uses up a slot that later tasks then lack."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drain(tasks: DataFrame, workers: DataFrame) -> DataFrame:
    """task, arch and worker: tasks of an architecture, by id, each take the free worker of least load."""
    options = workers.select("arch", F.lit(0).alias("kind"), "worker", "slots", (-F.col("load")).alias("score"))
    return drain_scored(tasks.select("arch", F.lit(0).alias("kind"), "task", F.lit(None).cast("long").alias("tried")), options)


def drain_scored(queue: DataFrame, options: DataFrame) -> DataFrame:
    """task, arch and worker: tasks (arch, kind, task, tried) by id, each take their kind's best free worker other than the one they tried.

    options (arch, kind, worker, slots, score) are the workers that a kind of task may take; of equal scores, the lower id is better.
    Slots make the result depend on order, but only within an architecture, so each is a group of its own. A task there holds the ranks of `ranked`, a few bytes
    for each option of a kind, and, of the queue, no more than slots times kinds times workers tried, whatever the queue's length. Of tasks of a kind that
    tried the same worker, no more can be served than their kind has slots, so only as many are gathered; a worker that isn't an
    option counts as none tried.
    """
    options = options.filter("slots > 0")
    room = options.groupBy("arch", "kind").agg(F.sum("slots").alias("room"))
    mine = options.select("arch", "kind", F.col("worker").alias("tried"), F.lit(True).alias("_open"))
    asked = queue.join(room, ["arch", "kind"]).join(mine, ["arch", "kind", "tried"], "left").withColumn("tried", F.when(F.col("_open"), F.col("tried")))
    # how many tasks come before each: counted in two steps, so that no queue is sorted in one place
    group = ["arch", "kind", "tried"]
    part = asked.withColumn("tried", F.coalesce("tried", F.lit(-1))).withColumn("chunk", F.expr("task div 1000"))
    sizes = part.groupBy(*group, "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*group, "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*group, "chunk").orderBy("task"))
    served = part.join(before, [*group, "chunk"]).withColumn("place", place).filter("place <= room").select("arch", "kind", "task", "tried")

    kinds = options.select("arch", "kind").distinct().withColumn("number", F.row_number().over(Window.partitionBy("arch").orderBy("kind")).cast("long"))
    lists, workers = ranked(options.join(kinds, ["arch", "kind"]))
    numbered = served.join(kinds, ["arch", "kind"]).select("arch", "task", F.col("number").alias("of"), "tried")
    fleet = lists.select("arch", "number", "ranks", F.lit(None).cast("array<long>").alias("workers"), F.lit(None).cast("array<long>").alias("slots"))
    fleet = fleet.unionByName(workers.withColumns({"number": F.lit(-1).cast("long"), "ranks": F.lit(None).cast("array<int>")}))
    return numbered.groupBy("arch").cogroup(fleet.groupBy("arch")).applyInPandas(_assign, "task long, arch string, worker long")


def ranked(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each kind, arch, number and ranks: its workers, best first, as places in `workers`; of each architecture, arch, workers and their slots.

    So what is long, a kind's name, stands once for a kind and not once for each of its workers.
    """
    order = F.struct(F.coalesce(-F.col("score"), F.lit(float("nan"))).alias("by"), "worker", "place")
    fleet = options.groupBy("arch", "worker").agg(F.max("slots").cast("long").alias("slots"))
    workers = fleet.groupBy("arch").agg(F.sort_array(F.collect_list(F.struct(F.col("worker").cast("long").alias("worker"), "slots"))).alias("w")).select("arch", "w.worker", "w.slots").withColumnRenamed("worker", "workers")
    place = workers.select("arch", F.posexplode("workers").alias("place", "worker"))
    lists = options.join(place, ["arch", "worker"]).groupBy("arch", "number").agg(F.sort_array(F.collect_list(order)).alias("r")).select("arch", "number", F.col("r.place").alias("ranks"))
    return lists, workers


def _assign(queue: pd.DataFrame, fleet: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(queue) and len(fleet):
        own = fleet[fleet["number"] < 0].iloc[0]
        workers, free = own["workers"], own["slots"].copy()
        ranks = {n: r for n, r in zip(fleet["number"], fleet["ranks"], strict=True) if n >= 0}
        first = dict.fromkeys(ranks, 0)
        queue = queue.sort_values("task")
        for task, kind, tried in zip(queue["task"], queue["of"], queue["tried"], strict=True):
            of, at = ranks[kind], first[kind]
            while at < len(of) and not free[of[at]]:
                at += 1
            first[kind] = at  # those before it stay full
            while at < len(of) and (workers[of[at]] == tried or not free[of[at]]):
                at += 1
            if at < len(of):
                free[of[at]] -= 1
                out.append((task, queue["arch"].iloc[0], workers[of[at]]))
    return pd.DataFrame(out, columns=["task", "arch", "worker"])
