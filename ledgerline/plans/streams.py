"""Streaming queries, run over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import shared_path
from ..sources.telemetry import KINDS
from ..streaming.rollups import drained, event_stream, minute_rollup, worker_states
from ..streaming.states import met, rate_edges, sessions, state_store, task_ends
from .base import TASKS, query
from .windows import LOOK_BACK, RATE, SAMPLES, TICKS


@query(f"""WITH {TASKS}, lag AS (SELECT max(at_us) - 60000000 AS mark FROM tasks), p AS (SELECT event_type AS metric, at_s // 60 * 60 AS bucket, sum(k)::DOUBLE AS sum, count(*) AS count FROM tasks GROUP BY 1, 2)
 SELECT p.* FROM p, lag WHERE (bucket + 60) * 1000000 <= mark // 1000 * 1000""")
def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minute rollup as a stream in append mode; the minutes that the watermark hasn't passed are withheld."""
    return drained(minute_rollup(event_stream(spark, sf_dir)), "stream-rollup")


@query(f"""WITH {TASKS}, e AS (SELECT project AS worker, id, event_type, max(CASE WHEN event_type = 'error' THEN id END) OVER w AS pin, max(CASE WHEN event_type = 'purchase' THEN id END) OVER w AS free FROM tasks
  WINDOW w AS (PARTITION BY project ORDER BY id)), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY worker ORDER BY id DESC) = 1)
 SELECT worker, id AS event_id, CASE WHEN event_type = 'click' THEN 'busy' WHEN event_type NOT IN ('view', 'error', 'purchase') THEN 'offline' WHEN pin IS NOT NULL AND (free IS NULL OR pin > free) THEN 'draining' ELSE 'online' END AS status FROM l""")
def stream_latest_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each worker, kept by a stateful operator and written batch by batch.

    Each batch has a folder of its own, which a batch that is run again overwrites; so none counts twice.
    """
    out, state = shared_path(spark, "stream-workers"), shared_path(spark, "stream-workers-state")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    worker_states(event_stream(spark, sf_dir)).writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("worker long, event_id long, status string, batch long").parquet(out)
    return rows.groupBy("worker").agg(F.max_by(F.struct("event_id", "status"), "batch").alias("s")).select("worker", "s.event_id", "s.status")


#: Milliseconds after which a task that has no result has expired.
EXPIRY = 6 * 3_600_000
_MARK = "mark AS (SELECT max(at_us) // 1000 - 60000 AS ms FROM tasks)"


@query(f"""WITH {TASKS}, {_MARK}, r AS (SELECT id // 4 AS task, id, at_us // 1000 AS at_ms, status FROM tasks), c AS (SELECT task, min(at_ms) AS created FROM r GROUP BY 1),
 f AS (SELECT task, arg_min(status, (at_ms, id)) AS status, min(at_ms) AS at FROM r WHERE status IN ('done', 'failed', 'canceled') GROUP BY 1), e AS (SELECT c.task, created, f.status, f.at AS came FROM c LEFT JOIN f ON f.task = c.task), m AS (SELECT task, max(at_ms) AS last FROM r GROUP BY 1)
 SELECT e.task, CASE WHEN came <= created + {EXPIRY} THEN came ELSE created + {EXPIRY} END AS "at", CASE WHEN came <= created + {EXPIRY} THEN status ELSE 'expired' END AS status FROM e JOIN m ON m.task = e.task, mark
 WHERE came <= created + {EXPIRY} OR last > created + {EXPIRY} OR created + {EXPIRY} < ms""")
def stream_task_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each task ended, told once by a stream with timers: its first terminal status, or that it expired; four events in a row report of a task."""
    status = F.expr("CASE event_id % 10 WHEN 6 THEN 'failed' WHEN 7 THEN 'queued' WHEN 8 THEN 'running' WHEN 9 THEN 'canceled' ELSE 'done' END")
    reports = event_stream(spark, sf_dir).withWatermark("at", "1 minute")
    reports = reports.select(F.expr("event_id div 4").alias("task"), F.col("event_id").alias("id"), F.unix_millis("at").alias("at_ms"), status.alias("status"), "at")
    with state_store(spark):
        return drained(task_ends(reports, EXPIRY), "stream-task-ends")


@query(f"""WITH {TICKS}, lag AS (SELECT max(at_us) // 1000 - 60000 AS ms FROM tasks) SELECT rule, tick, CASE WHEN firing THEN 'raise' ELSE 'resolve' END AS edge FROM e, lag WHERE firing <> before AND rule IN ('infra_error_rate', 'timeout_rate') AND (tick + 1) * 3600000 <= ms""")
def stream_alert_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the alerts on rates are raised and resolved, by a stream of sliding windows: the edges of the batch, but for hours that the watermark hasn't passed."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rows = event_stream(spark, sf_dir).withWatermark("at", "1 minute").select("at", F.coalesce(kind[F.col("event_type")], F.lit("timeout")).alias("result_kind"))
    with state_store(spark):
        return drained(rate_edges(rows, {"infra_error_rate": "infra_error", "timeout_rate": "timeout"}, 3600, LOOK_BACK, SAMPLES, RATE), "stream-alerts")


@query(f"""WITH {TASKS}, a AS (SELECT id, project, at_us FROM tasks WHERE event_type = 'view'), r AS (SELECT id, project, at_us FROM tasks WHERE event_type = 'purchase'),
 lag AS (SELECT least((SELECT max(at_us) FROM a), (SELECT max(at_us) FROM r)) // 1000 - 60000 AS ms), j AS (SELECT a.id AS attempt, r.id AS result, a.at_us FROM a LEFT JOIN r ON r.project = a.project AND r.at_us BETWEEN a.at_us AND a.at_us + 7200000000)
 SELECT attempt, result FROM j, lag WHERE result IS NOT NULL OR at_us // 1000 + 7200000 < ms""")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts (views) with the results (purchases) that come within two hours, by a join of two streams; those without one, once both have got past that."""
    side = lambda kind, name: event_stream(spark, sf_dir).filter(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias(name), "at").withWatermark("at", "1 minute")
    return drained(met(side("view", "attempt"), side("purchase", "result"), "2 HOURS"), "stream-attempts")


@query(f"""WITH {TASKS}, g AS (SELECT project, at_us, CASE WHEN at_us - lag(at_us) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh, id FROM tasks WINDOW w AS (PARTITION BY project ORDER BY at_us, id)), s AS (SELECT project, at_us, sum(fresh) OVER (PARTITION BY project ORDER BY at_us, id) AS k FROM g),
 lag AS (SELECT max(at_us) // 1000 - 60000 AS ms FROM tasks), o AS (SELECT project AS key, min(at_us) // 1000000 AS start, max(at_us) AS ended, count(*) AS n FROM s GROUP BY project, k) SELECT key, start, ended // 1000000 AS last, n FROM o, lag WHERE (ended + 3600000000) // 1000 <= ms""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each project, an hour of silence apart, by a stream of session windows; those that may still go on are withheld."""
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "at").withWatermark("at", "1 minute")
    return drained(sessions(rows, "1 hour"), "stream-sessions")
