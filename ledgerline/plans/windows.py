"""Windows: waterfalls, latest and earliest rows, health and alert folds, notices, races and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ratio
from ..operators.folds import edges, first_per, health_fold
from ..operators.leases import granted
from ..sources.telemetry import as_of, load, tasks
from .base import TASKS, query


@query(f"""WITH {TASKS} SELECT id, at_us // 1000 - first_value(at_us // 1000) OVER w AS start_ms, CASE WHEN lead(at_us) OVER w IS NULL THEN 1 ELSE greatest(lead(at_us // 1000) OVER w - at_us // 1000, 1) END AS span_ms
 FROM tasks WINDOW w AS (PARTITION BY project ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def phase_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's start after the first of its timeline, and its span to the next, at least 1; the last spans 1."""
    w = Window.partitionBy("project").orderBy("at_us", "id")
    t = tasks(spark, sf_dir).withColumn("ms", F.expr("at_us div 1000"))
    return t.select("id", (F.col("ms") - F.first("ms").over(w)).alias("start_ms"), F.coalesce(F.greatest(F.lead("ms").over(w) - F.col("ms"), F.when(F.lead("ms").over(w).isNotNull(), F.lit(1))), F.lit(1)).alias("span_ms"))


@query(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY project, worktree ORDER BY at_us DESC, id DESC) AS rn FROM tasks, now WHERE result_kind IN ('success', 'compile_error') AND status = 'done' AND at_us > us - 86400000000)
 SELECT project, worktree, id, result_kind FROM r WHERE rn = 1""")
def latest_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest cacheable result of each key in the last day."""
    t = tasks(spark, sf_dir)
    fresh = t.filter(F.col("result_kind").isin("success", "compile_error") & (F.col("status") == "done") & (F.col("at_us") > as_of(t) - 86_400_000_000))
    return first_per(fresh, ["project", "worktree"], [F.desc("at_us"), F.desc("id")]).select("project", "worktree", "id", "result_kind")


@query(f"WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY at_us, id) AS rn FROM tasks WHERE status IN ('queued', 'running')) SELECT project, id FROM r WHERE rn = 1")
def earliest_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest task of each project that is still under way."""
    return first_per(tasks(spark, sf_dir).filter(F.col("status").isin("queued", "running")), ["project"], ["at_us", "id"]).select("project", "id")


_HEALTH = f"""{TASKS}, e AS (SELECT *, k % 20 AS digest, result_kind = 'env_error' AND build_ms % 5 <> 0 AS counted FROM tasks WHERE result_kind IN ('success', 'env_error')),
 p AS (SELECT *, sum(CASE WHEN result_kind = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY digest ORDER BY at_us, id) AS epoch, CASE WHEN counted THEN project END AS origin FROM e),
 q AS (SELECT *, last_value(origin IGNORE NULLS) OVER (PARTITION BY digest, epoch ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
 s AS (SELECT *, sum(CASE WHEN origin IS NOT NULL AND origin IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY digest, epoch ORDER BY at_us, id) AS streak FROM q)"""


@query(f"WITH {_HEALTH} SELECT digest, count(*) AS total, count(*) FILTER (WHERE result_kind = 'success') AS successes, arg_max(streak, (at_us, id))::BIGINT AS streak, arg_max(streak, (at_us, id)) >= 3 AS failing FROM s GROUP BY 1")
def image_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's last state: failures from changing projects since its last success, three of which make it failing."""
    s = image_streaks(tasks(spark, sf_dir))
    last = F.max_by(F.struct("streak", "failing"), F.struct("at_us", "id"))
    return s.groupBy("digest").agg(F.count("*").alias("total"), F.count_if(F.col("result_kind") == "success").alias("successes"), last["streak"].alias("streak"), last["failing"].alias("failing"))


def image_streaks(t: DataFrame) -> DataFrame:
    """Tasks that tell of an image's health, with the streak of failures and whether the image is failing after each."""
    e = t.filter(F.col("result_kind").isin("success", "env_error")).withColumn("digest", F.col("k") % 20)
    counted = (F.col("result_kind") == "env_error") & (F.col("build_ms") % 5 != 0)
    return health_fold(e, "digest", ["at_us", "id"], F.col("result_kind") == "success", counted, F.col("project"))


#: Alerts: tasks waiting above which the queue is too long, share of results above which a rate is too high, results without which a rate
#: decides nothing, ticks that a rate looks back over, ticks of silence after which a worker is offline, and ticks after which the queue starts anew;
#: and tasks of a kind of event without which their share of failures in a tick decides nothing.
BACKLOG, RATE, SAMPLES, LOOK_BACK, SILENCE, PERIOD, FEW = 50, 0.2, 20, 15, 24, 96, 3

TICKS = f"""{TASKS}, t AS (SELECT *, at_s // 3600 AS tick FROM tasks), span AS (SELECT min(tick) AS lo, max(tick) AS hi FROM t), grid AS (SELECT unnest(range(lo, hi + 1)) AS tick FROM span),
 c AS (SELECT g.tick, count(id) AS n, count(id) AS fin, count(id) FILTER (WHERE result_kind = 'infra_error') AS infra, count(id) FILTER (WHERE result_kind = 'timeout') AS late,
  count(id) FILTER (WHERE result_kind IN ('env_error', 'compile_error')) AS came FROM grid g LEFT JOIN t ON t.tick = g.tick GROUP BY 1),
 w AS (SELECT tick, n, sum(fin) OVER v AS fin, sum(infra) OVER v AS infra, sum(late) OVER v AS late, sum(came) OVER (PARTITION BY tick // {PERIOD} ORDER BY tick) AS waiting FROM c WINDOW v AS (ORDER BY tick ROWS BETWEEN {LOOK_BACK - 1} PRECEDING AND CURRENT ROW)),
 f AS (SELECT 'queue_backlog' AS rule, tick, waiting > {BACKLOG} AS firing FROM w UNION ALL SELECT 'infra_error_rate', tick, CASE WHEN fin >= {SAMPLES} THEN infra / fin > {RATE} END FROM w
  UNION ALL SELECT 'timeout_rate', tick, CASE WHEN fin >= {SAMPLES} THEN late / fin > {RATE} END FROM w UNION ALL SELECT 'no_workers', tick, n = 0 FROM w),
 e AS (SELECT *, coalesce(lag(firing) OVER (PARTITION BY rule ORDER BY tick), false) AS before FROM f WHERE firing IS NOT NULL)"""


@query(f"""WITH {TICKS}, {_HEALTH.removeprefix(TASKS + ", ").replace("e AS (", "he AS (").replace("FROM e)", "FROM he)")},
 s2 AS (SELECT worker, tick, lead(tick) OVER (PARTITION BY worker ORDER BY tick) AS again FROM (SELECT DISTINCT 'w' || project AS worker, tick FROM t))
 SELECT rule, tick, CASE WHEN firing THEN 'raise' ELSE 'resolve' END AS edge FROM e WHERE firing <> before
 UNION ALL SELECT 'image_failing:' || digest, min(at_s) // 3600, 'raise' FROM s WHERE streak >= 3 GROUP BY 1
 UNION ALL SELECT 'worker_offline:' || worker, tick + {SILENCE + 1}, 'raise' FROM s2, span WHERE coalesce(again, hi + 1) > tick + {SILENCE + 1} OR again = tick + {SILENCE + 1}
 UNION ALL SELECT 'worker_offline:' || worker, again, 'resolve' FROM s2 WHERE again > tick + {SILENCE + 1} OR again = tick + {SILENCE + 1}
 UNION ALL SELECT 'failed:' || event_type, tick, CASE WHEN firing THEN 'raise' ELSE 'resolve' END FROM (SELECT *, coalesce(lag(firing) OVER (PARTITION BY event_type ORDER BY tick), false) AS before
  FROM (SELECT event_type, tick, CASE WHEN count(*) >= {FEW} THEN count(*) FILTER (WHERE status = 'failed') / count(*) > {RATE} END AS firing FROM t GROUP BY 1, 2) WHERE firing IS NOT NULL) WHERE firing <> before""".replace(f" OR again = tick + {SILENCE + 1}", ""))
def alert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each alert is raised and resolved; an hour of the events stands for a minute of a fleet, projects for workers and images by payload."""
    t = tasks(spark, sf_dir).withColumn("tick", F.expr("at_s div 3600"))
    # rates are of all tasks that were created, whatever became of them
    counts = t.groupBy("tick").agg(
        F.count("*").alias("n"), F.count("*").alias("fin"), F.count_if(F.col("result_kind") == "infra_error").alias("infra"), F.count_if(F.col("result_kind") == "timeout").alias("late"),
        F.count_if(F.col("result_kind").isin("env_error", "compile_error")).alias("came"),
    )
    failing = image_streaks(t).filter("failing").select(F.concat(F.lit("image_failing:"), "digest").alias("rule"), "tick")
    seen = t.select(F.concat(F.lit("w"), "project").alias("worker"), "tick").distinct()
    return fleet_alerts(counts).unionByName(raised_once(failing)).unionByName(silences(seen)).unionByName(failures(t))


def failures(t: DataFrame) -> DataFrame:
    """rule, tick and edge of each kind of event (`t`: event_type, tick, status): whether over RATE of its tasks in a tick failed; below FEW nothing is decided."""
    shares = t.groupBy("event_type", "tick").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("bad"))
    firing = F.when(F.col("n") >= FEW, F.col("bad") / F.col("n") > RATE)
    return edges(shares, "event_type", "tick", firing).select(F.concat(F.lit("failed:"), "event_type").alias("rule"), "tick", "edge")


def fleet_alerts(counts: DataFrame) -> DataFrame:
    """rule, tick and edge of the rules that counts per tick decide: backlog, rates of infrastructure errors and time outs, and no workers.

    counts: tick, n (reports of any worker), fin, infra and late (tasks created, and those of two kinds), came (tasks that began to wait; the queue starts anew
    every PERIOD ticks). Ticks without a row count as zeros. Rates look back over LOOK_BACK ticks; below SAMPLES tasks they decide nothing.
    """
    grid = counts.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).filter("lo IS NOT NULL").select("hi", F.explode(F.sequence("lo", "hi")).alias("tick"))
    full = grid.join(counts, "tick", "left").na.fill(0)
    ahead = full.select(F.explode(F.sequence(F.col("tick"), F.least(F.col("tick") + (LOOK_BACK - 1), F.col("hi")))).alias("tick"), "fin", "infra", "late")
    rates = ahead.groupBy("tick").agg(*[F.sum(c).alias(c) for c in ("fin", "infra", "late")])
    waiting = F.sum("came").over(Window.partitionBy(F.expr(f"tick div {PERIOD}")).orderBy("tick"))
    now = full.select("tick", "n", waiting.alias("waiting")).join(rates, "tick")
    rate = lambda c: F.when(F.col("fin") >= SAMPLES, ratio(F.col(c), F.col("fin")) > RATE)
    rules = {"queue_backlog": F.col("waiting") > BACKLOG, "infra_error_rate": rate("infra"), "timeout_rate": rate("late"), "no_workers": F.col("n") == 0}
    each = now.select("tick", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("firing")) for k, v in rules.items()])).alias("x")).select("x.rule", "tick", "x.firing")
    return edges(each, "rule", "tick", F.col("firing")).select("rule", "tick", "edge")


def raised_once(firing: DataFrame) -> DataFrame:
    """rule, tick and edge of rules that nothing resolves: each is raised the first time it fires (`firing`: rule, tick), and never again."""
    return firing.groupBy("rule").agg(F.min("tick").alias("tick")).withColumn("edge", F.lit("raise"))


def silences(seen: DataFrame) -> DataFrame:
    """rule, tick and edge of workers that fall silent (`seen`: worker, tick, once each): offline after SILENCE ticks, resolved when they report again."""
    last = seen.agg(F.max("tick")).scalar()
    again = F.lead("tick").over(Window.partitionBy("worker").orderBy("tick"))
    quiet = seen.withColumn("again", again).withColumn("off", F.col("tick") + (SILENCE + 1)).filter(F.coalesce("again", last + 1) > F.col("off"))
    both = F.array(F.struct(F.col("off").alias("tick"), F.lit("raise").alias("edge")), F.struct(F.col("again").alias("tick"), F.lit("resolve").alias("edge")))
    return quiet.select(F.concat(F.lit("worker_offline:"), "worker").alias("rule"), F.explode(both).alias("x")).select("rule", "x.tick", "x.edge").filter("tick IS NOT NULL")


_NOTICES = f"""{TASKS}, n AS (SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY at_us, id) AS seq, k, event_type FROM tasks),
 s AS (SELECT project, seq, event_type AS category, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity, (k // 25)::VARCHAR AS identity FROM n)"""


@query(f"""WITH {_NOTICES}, l AS (SELECT *, lag(seq) OVER w AS ls, lag(identity) OVER w AS li FROM s WINDOW w AS (PARTITION BY project, category ORDER BY seq))
 SELECT project, seq, category, CASE WHEN ls = seq - 1 AND li = identity THEN CASE WHEN severity = 'critical' THEN 'compact' ELSE 'silent' END ELSE 'full' END AS form FROM l""")
def notice_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each notice is told: in full when it is new or changed, else short if critical, else not at all. Only the snapshot just before counts."""
    w = Window.partitionBy("project", "category").orderBy("seq")
    same = (F.lag("seq").over(w) == F.col("seq") - 1) & (F.lag("identity").over(w) == F.col("identity"))
    form = F.when(same, F.when(F.col("severity") == "critical", "compact").otherwise("silent")).otherwise("full")
    return notice_snapshot(spark, sf_dir).select("project", "seq", "category", form.alias("form"))


@query(f"WITH {_NOTICES} SELECT * FROM s")
def notice_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notice per task: its category, severity and what identifies it."""
    seq = F.row_number().over(Window.partitionBy("project").orderBy("at_us", "id")).cast("long")
    severity = F.when(F.col("event_type") == "error", "critical").otherwise("info")
    return tasks(spark, sf_dir).select("project", seq.alias("seq"), F.col("event_type").alias("category"), severity.alias("severity"), F.expr("cast(k div 25 as string)").alias("identity"))


@query(f"""WITH {TASKS}, r AS (SELECT project, worktree, id, status, row_number() OVER (PARTITION BY project, worktree ORDER BY at_us, id) AS rn FROM tasks WHERE status IN ('done', 'failed', 'canceled'))
 SELECT project, worktree, id, status FROM r WHERE rn = 1""")
def first_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terminal state that was written first; later ones never overwrite it."""
    return first_per(tasks(spark, sf_dir).filter(F.col("status").isin("done", "failed", "canceled")), ["project", "worktree"], ["at_us", "id"]).select("project", "worktree", "id", "status")


@query(f"""WITH {TASKS} SELECT project, min(at_us) FILTER (WHERE status = 'running') AS first_start, coalesce(arg_min(at_us, (at_us, id)) FILTER (WHERE status = 'running') - min(at_us), 0) AS latency_us FROM tasks GROUP BY 1""")
def first_start_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each project's first run started, and how long after its first task."""
    start = F.min(F.when(F.col("status") == "running", F.col("at_us")))
    return tasks(spark, sf_dir).groupBy("project").agg(start.alias("first_start"), F.coalesce(start - F.min("at_us"), F.lit(0)).alias("latency_us"))


@query(f"WITH {TASKS}, r AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY at_us DESC, id DESC) AS rn FROM tasks) SELECT project, id, rn FROM r WHERE rn <= 120")
def last_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 120 samples of each project."""
    rn = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("at_us"), F.desc("id")))
    return tasks(spark, sf_dir).select("project", "id", rn.alias("rn")).filter("rn <= 120")


@query(f"WITH {TASKS} SELECT id, max(k) OVER w AS progress, row_number() OVER w AS version FROM tasks WINDOW w AS (PARTITION BY project ORDER BY at_us, id)")
def progress_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress that never goes back, and a version that always goes on."""
    w = Window.partitionBy("project").orderBy("at_us", "id")
    return tasks(spark, sf_dir).select("id", F.max("k").over(w).alias("progress"), F.row_number().over(w).alias("version"))


@query(f"""WITH {TASKS}, e AS (SELECT *, k % 30 AS digest FROM tasks WHERE event_type IN ('purchase', 'view', 'signup')), f AS (SELECT digest, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'view' THEN 'build_ok' ELSE 'build_failed' END AS act, at_us, id, project FROM e)
 SELECT digest, coalesce(arg_max(CASE act WHEN 'build_ok' THEN 'healthy' ELSE 'failed' END, (at_us, id)) FILTER (WHERE act <> 'approve'), 'pending') AS status,
 coalesce(arg_max('u' || project, (at_us, id)) FILTER (WHERE act = 'approve'), '') AS approved_by, coalesce(arg_min(CASE WHEN project % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END, (at_us, id)) FILTER (WHERE act = 'build_ok'), '') AS arch FROM f GROUP BY 1""")
def image_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What approvals and builds make of each image: the last build decides its health, the first good one its architecture."""
    act = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "view", "build_ok").when(F.col("event_type") == "signup", "build_failed")
    e = tasks(spark, sf_dir).withColumn("act", act).filter("act is not null").withColumn("digest", F.col("k") % 30)
    at = F.struct("at_us", "id")
    build, approve, good = F.col("act") != "approve", F.col("act") == "approve", F.col("act") == "build_ok"
    status = F.max_by(F.when(good, "healthy").otherwise("failed"), F.when(build, at))
    return e.groupBy("digest").agg(
        F.coalesce(F.when(F.count_if(build) > 0, status), F.lit("pending")).alias("status"),
        F.coalesce(F.when(F.count_if(approve) > 0, F.max_by(F.concat(F.lit("u"), F.col("project")), F.when(approve, at))), F.lit("")).alias("approved_by"),
        F.coalesce(F.when(F.count_if(good) > 0, F.min_by(F.when(F.col("project") % 2 == 0, "x86_64").otherwise("aarch64"), F.when(good, at))), F.lit("")).alias("arch"),
    )


@query(f"""WITH {TASKS}, r AS (SELECT *, min(CASE WHEN status IN ('done', 'failed', 'canceled') THEN at_us END) OVER (PARTITION BY project, worktree ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_at FROM tasks)
 SELECT id, CASE status WHEN 'queued' THEN 'pending' WHEN 'running' THEN 'building' ELSE 'terminal' END AS phase, over_at IS NOT NULL AS dropped FROM r""")
def late_result_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come after a key's first terminal one are dropped."""
    w = Window.partitionBy("project", "worktree").orderBy("at_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    over = F.min(F.when(F.col("status").isin("done", "failed", "canceled"), F.col("at_us"))).over(w)
    phase = F.when(F.col("status") == "queued", "pending").when(F.col("status") == "running", "building").otherwise("terminal")
    return tasks(spark, sf_dir).select("id", phase.alias("phase"), over.isNotNull().alias("dropped"))


#: Microseconds that a lease holds, and the environments that claims are for.
LEASE, ENVIRONMENTS = 3_600_000_000, 20


@query(f"""WITH RECURSIVE {TASKS}, c AS (SELECT id, project % {ENVIRONMENTS} AS env, project % 7 AS worker, at_us AS came FROM tasks WHERE status <> 'failed'),
 w AS (SELECT project % 7 AS worker, at_us AS off, event_type, coalesce(lead(at_us) OVER (PARTITION BY project % 7 ORDER BY at_us, id), 9223372036854775807) AS until FROM tasks), o AS (SELECT worker, off, until FROM w WHERE event_type = 'error' AND until > off),
 n AS (SELECT *, row_number() OVER (PARTITION BY env ORDER BY came, id) AS k FROM c),
 g AS (SELECT env, k, came, worker, k AS held, came AS held_at, worker AS held_by, true AS granted FROM n WHERE k = 1
  UNION ALL SELECT n.env, n.k, n.came, n.worker, CASE WHEN x.ok THEN n.k ELSE g.held END, CASE WHEN x.ok THEN n.came ELSE g.held_at END, CASE WHEN x.ok THEN n.worker ELSE g.held_by END, x.ok FROM g JOIN n ON n.env = g.env AND n.k = g.k + 1,
   LATERAL (SELECT n.came - g.held_at >= {LEASE} OR EXISTS (SELECT 1 FROM o WHERE o.worker = g.held_by AND o.off <= n.came AND n.came < o.until) AS ok) x)
 SELECT n.id, g.granted FROM g JOIN n ON n.env = g.env AND n.k = g.k""")
def lease_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims of an environment are granted: those that find no lease, an old one, or one whose worker is offline; a refused claim renews nothing."""
    t = tasks(spark, sf_dir)
    claims = t.filter("status <> 'failed'").select((F.col("project") % ENVIRONMENTS).alias("key"), "id", F.col("at_us").alias("at"), (F.col("project") % 7).alias("worker"))
    until = F.lead("at_us").over(Window.partitionBy("worker").orderBy("at_us", "id"))
    reports = t.withColumn("worker", F.col("project") % 7).withColumn("until", F.coalesce(until, F.lit(2**63 - 1)))
    return granted(claims, reports.filter("event_type = 'error' AND until > at_us").select("worker", F.col("at_us").alias("off"), "until"), LEASE)


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, count(*) OVER w AS turns_so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order, each with the role before it and how many there were."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("previous_role"), F.count("*").over(w).alias("turns_so_far"))
