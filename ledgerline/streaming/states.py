"""Streams with state of their own: tasks that end once or expire, alerts that change, attempts that meet their results, and sessions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Statuses that end a task.
TERMINAL = ("done", "failed", "canceled")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """While it is open, streams that start keep their state in RocksDB, which processors with timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


#: Tasks that share a state: handing a state to Python and back takes as long for a thousand tasks as for one.
TOGETHER = 1000


def task_ends(reports: DataFrame, ttl: int) -> DataFrame:
    """task, at (milliseconds) and status of each task's end, told once; reports: task, id, at_ms, status and the event time `at`, with a watermark.

    A task ends by its first terminal status. One that has none `ttl` milliseconds after its first report has expired, which a timer tells; whatever is
    reported later, or a second time, changes nothing. Tasks of neighbouring numbers share a state, and its timer stands at the first of their expiries.
    """

    def end(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
        ends = []
        rows = (zip(*[b[c].tolist() for c in ("at_ms", "id", "task", "status")], strict=True) for b in batches)
        for at, _, task, status in sorted((r for b in rows for r in b), key=lambda r: r[:2]):
            created, over = held.get(task, (at, False))
            if not over and (at > created + ttl or status in TERMINAL):
                ends.append((task, at, status) if at <= created + ttl else (task, created + ttl, "expired"))
                over = True
            held[task] = created, over
        passed = state.getCurrentWatermarkMs()
        for task, (created, over) in held.items():
            if not over and created + ttl < passed:
                ends.append((task, created + ttl, "expired"))
                held[task] = created, True
        state.update((list(held), [c for c, _ in held.values()], [o for _, o in held.values()]))
        if waiting := [c for c, over in held.values() if not over]:
            state.setTimeoutTimestamp(max(min(waiting) + ttl, passed, 1))
        yield pd.DataFrame(ends, columns=["task", "at", "status"])

    rows = reports.filter("task IS NOT NULL").withColumn("of", F.expr(f"task div {TOGETHER}")).groupBy("of")
    return rows.applyInPandasWithState(end, "task long, at long, status string", "tasks array<long>, created array<long>, over array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


class Edges(StatefulProcessor):
    """When a rule begins to fire and ceases to; what it last was is kept, and a null decides nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firing = handle.getValueState("firing", "firing boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r["tick"]):
            before = self.firing.exists() and self.firing.get()[0]
            if r["firing"] is None or r["firing"] == before:
                continue
            self.firing.update((r["firing"],))
            yield Row(rule=key[0], tick=r["tick"], edge="raise" if r["firing"] else "resolve")

    def close(self) -> None:
        pass


def rate_edges(tasks: DataFrame, kinds: dict[str, str], tick: int, ticks: int, samples: int, rate: float) -> DataFrame:
    """rule, tick and edge of rates over the last `ticks` ticks of `tick` seconds, told when the watermark has passed a tick.

    tasks: at (with a watermark) and result_kind; kinds: rule and the kind it watches. Below `samples` tasks a rate decides nothing.
    """
    spans = tasks.groupBy(F.window("at", f"{tick * ticks} seconds", f"{tick} seconds")).agg(F.count("*").alias("n"), *[F.count_if(F.col("result_kind") == kind).alias(rule) for rule, kind in kinds.items()])
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.when(F.col("n") >= samples, F.col(rule) / F.col("n") > rate).alias("firing")) for rule in kinds])
    rows = spans.select((F.expr(f"unix_seconds(window.end) div {tick}") - 1).alias("tick"), F.explode(each).alias("x")).select("x.rule", "tick", "x.firing")
    return rows.groupBy("rule").transformWithState(Edges(), "rule string, tick long, edge string", "Append", "None")


def met(attempts: DataFrame, results: DataFrame, within: str) -> DataFrame:
    """attempt and result for attempts (key, attempt, at) and the results (key, result, at) of their key that come within a bound after them; without any, null.

    Both have watermarks, so an attempt is held no longer than its bound, and one that is alone is told when both watermarks have passed that.
    """
    a, r = attempts.select(F.col("key").alias("_key"), "attempt", F.col("at").alias("_at")), results
    bound = (F.col("_key") == F.col("key")) & (F.col("at") >= F.col("_at")) & (F.col("at") <= F.col("_at") + F.expr(f"INTERVAL {within}"))
    return a.join(r, bound, "left_outer").select("attempt", "result")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """key, start and last (seconds) and n of each session: events of a key with less than `gap` between neighbours; told when the watermark has passed its end."""
    spans = events.groupBy("key", F.session_window("at", gap)).agg(F.count("*").alias("n"), F.max(F.unix_seconds("at")).alias("last"))
    return spans.select("key", F.unix_seconds("session_window.start").alias("start"), "last", "n")
