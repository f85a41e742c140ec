"""Fleet analytics: counters, percentiles, histograms, rollups, series and store reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bucket, ratio
from ..operators.ranks import nearest_ranks
from ..operators.rollup import fold, minute_points
from ..sources.stores import append, held, put, settled, shared_path
from ..sources.telemetry import as_of, load, tasks
from .base import ORACLES, TASKS, query

DAY_US = 86_400_000_000


@query(f"""WITH {TASKS} SELECT (SELECT count(*) FROM tasks WHERE status = 'running') AS running, (SELECT count(*) FROM tasks WHERE status = 'queued') AS queued,
 count(*) AS total, count(*) FILTER (WHERE result_kind = 'success') AS success, count(*) FILTER (WHERE result_kind = 'compile_error') AS compile_error,
 count(*) FILTER (WHERE result_kind = 'env_error') AS env_error, count(*) FILTER (WHERE result_kind = 'infra_error') AS infra_error,
 count(*) FILTER (WHERE k % 5 = 0) AS cache_hits, coalesce(sum(k * 1024), 0)::BIGINT AS bytes_synced,
 CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE result_kind = 'success') / count(*) ELSE 0.0 END AS success_rate
 FROM tasks, now WHERE at_us > us - {DAY_US}""")
def overview_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's card in one pass: two states over all time, the rest over tasks created in the last day, whatever their state."""
    t = tasks(spark, sf_dir)
    late = F.col("at_us") > as_of(t) - DAY_US
    kinds = [F.count_if(late & (F.col("result_kind") == k)).alias(k) for k in ("success", "compile_error", "env_error", "infra_error")]
    out = t.agg(
        F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(late).alias("total"), *kinds,
        F.count_if(late & (F.col("k") % 5 == 0)).alias("cache_hits"), F.coalesce(F.sum(F.when(late, F.col("k") * 1024)), F.lit(0)).alias("bytes_synced"),
    )
    return out.withColumn("success_rate", ratio(F.col("success"), F.col("total")))


_PCT = "list_sort(list({0}) FILTER (WHERE {0} > 0))[CAST(round((count(*) FILTER (WHERE {0} > 0) - 1) * {1}::DOUBLE) AS INT) + 1]"


@query(
    f"WITH {TASKS} SELECT result_kind, "
    + ", ".join(f"coalesce({_PCT.format(c, p)}, 0) AS {c[:-3]}_p{int(p * 100)}" for c in ("queue_ms", "sync_ms", "build_ms") for p in (0.5, 0.95))
    + " FROM tasks GROUP BY result_kind"
)
def phase_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the phases, of positive values only, by kind of result."""
    t = tasks(spark, sf_dir)
    phases = ("queue_ms", "sync_ms", "build_ms")
    long = t.select("result_kind", F.explode(F.array(*[F.struct(F.lit(c).alias("phase"), F.col(c).alias("v")) for c in phases])).alias("x")).select("result_kind", "x.phase", "x.v")
    per = nearest_ranks(long, ["result_kind", "phase"], "v", {"p50": 0.5, "p95": 0.95})
    wide = [F.coalesce(F.max(F.when(F.col("phase") == c, F.col(p))), F.lit(0)).alias(f"{c[:-3]}_{p}") for c in phases for p in ("p50", "p95")]
    return t.select("result_kind").distinct().join(per, "result_kind", "left").groupBy("result_kind").agg(*wide)


@query(f"""WITH {TASKS} SELECT at_s // 300 * 300 AS bucket, count(*) AS total, count(*) FILTER (WHERE result_kind = 'success') AS success, count(*) FILTER (WHERE k % 5 = 0) AS cache_hits
 FROM tasks, now WHERE at_s >= s - 14400 GROUP BY 1""")
def task_histogram_300s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of the last four hours in buckets of five minutes; buckets without tasks are absent."""
    t = tasks(spark, sf_dir)
    t = t.filter(F.col("at_s") >= as_of(t, "at_s") - 14_400)
    return t.groupBy(bucket(F.col("at_s"), 300).alias("bucket")).agg(F.count("*").alias("total"), F.count_if(F.col("result_kind") == "success").alias("success"), F.count_if(F.col("k") % 5 == 0).alias("cache_hits"))


_MINUTE = "points AS (SELECT event_type AS metric, at_s // 60 * 60 AS bucket, sum(k)::DOUBLE AS sum, count(*) AS count FROM tasks, now WHERE at_s // 60 * 60 < s // 60 * 60 GROUP BY 1, 2)"


@query(f"WITH {TASKS}, {_MINUTE} SELECT * FROM points")
def rollup_1min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count per metric and minute; the minute in progress is held back."""
    return minute_points(tasks(spark, sf_dir))


@query(f"WITH {TASKS}, {_MINUTE} SELECT * FROM points UNION ALL SELECT 'all', min(bucket), sum(sum), sum(count)::BIGINT FROM points")
def rollup_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of minute rollups after two flushes that add up, of tasks of even and odd number, an appended row, and that row put anew."""
    t = tasks(spark, sf_dir)
    path, schema, keys = shared_path(spark, "rollups"), "metric string, bucket long, sum double, count long, day long", ["metric", "bucket", "day"]
    dated = lambda rows: rows.withColumn("day", F.expr("bucket div 86400"))
    whole = minute_points(t)
    for side in (0, 1):
        put(dated(minute_points(t.filter(F.col("id") % 2 == side), as_of(t, "at_s"))), path, schema, keys, ["day"], ["sum", "count"])
    summed = dated(whole.agg(F.lit("all").alias("metric"), F.min("bucket").alias("bucket"), F.sum("sum").alias("sum"), F.sum("count").alias("count")))
    append(summed.withColumn("count", F.lit(-1).cast("long")), path, ["day"])
    put(summed, path, schema, keys, ["day"])
    return held(spark, path, schema).drop("day")


@query(f"WITH {TASKS}, {_MINUTE} SELECT metric, bucket // 3600 * 3600 AS bucket, sum(sum) AS sum, sum(count)::BIGINT AS count FROM points GROUP BY 1, 2")
def rollup_1hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes' points folded into hours."""
    return fold(minute_points(tasks(spark, sf_dir)), 3600)


@query(f"""WITH {TASKS}, {_MINUTE}, hours AS (SELECT metric, bucket // 3600 * 3600 AS bucket, sum(sum) AS sum, sum(count) AS count FROM points GROUP BY 1, 2)
 SELECT metric, bucket, CASE WHEN count > 0 THEN sum / count ELSE 0.0 END AS avg FROM hours, now WHERE bucket >= s - 7 * 86400""")
def series_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of the last seven days' hours."""
    t = tasks(spark, sf_dir)
    hours = fold(minute_points(t), 3600).filter(F.col("bucket") >= as_of(t, "at_s") - 7 * 86_400)
    return hours.select("metric", "bucket", ratio(F.col("sum"), F.col("count")).alias("avg"))


@query(f"""WITH {TASKS}, names(metric) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('api_requests_total'))
 SELECT n.metric, coalesce(sum(k), 0)::BIGINT AS total, count(id) AS samples, coalesce(arg_max(k, (at_us, id)), 0) AS gauge FROM names n LEFT JOIN tasks t ON t.event_type = n.metric GROUP BY 1""")
def metric_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, observations and last values of every declared metric; those without samples are 0."""
    names = spark.createDataFrame([(m,) for m in ("click", "error", "purchase", "signup", "view", "api_requests_total")], "metric string")
    sums = tasks(spark, sf_dir).groupBy(F.col("event_type").alias("metric")).agg(F.sum("k").alias("total"), F.count("*").alias("samples"), F.max_by("k", F.struct("at_us", "id")).alias("gauge"))
    return names.join(sums, "metric", "left").na.fill(0, ["total", "samples", "gauge"])


@query(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY at_us DESC, id DESC) AS rn FROM tasks WHERE status = 'done' AND result_kind IN ('success', 'compile_error', 'env_error')),
 l AS (SELECT * FROM r WHERE rn <= 20)
 SELECT project, count(*) AS runs, coalesce((list_sort(list(build_ms) FILTER (WHERE build_ms > 0)))[(count(*) FILTER (WHERE build_ms > 0)) // 2 + 1], 0) AS build_p50,
 coalesce(arg_max(k, (at_us, id)) FILTER (WHERE k > 0), 0) AS units FROM l GROUP BY 1""")
def history_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a project's last twenty finished runs suggest: the middle build time, and the latest count of units that isn't 0."""
    t = tasks(spark, sf_dir).filter("status = 'done' AND result_kind IN ('success', 'compile_error', 'env_error')")
    last = t.withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("at_us"), F.desc("id")))).filter("rn <= 20")
    values = F.sort_array(F.collect_list(F.when(F.col("build_ms") > 0, F.col("build_ms"))))
    middle = F.coalesce(F.get(values, F.floor(F.size(values) / 2).cast("int")), F.lit(0))
    return last.groupBy("project").agg(F.count("*").alias("runs"), middle.alias("build_p50"), F.coalesce(F.max_by(F.when(F.col("k") > 0, F.col("k")), F.when(F.col("k") > 0, F.struct("at_us", "id"))), F.lit(0)).alias("units"))


@query("""WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT count(*) AS blobs, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS bytes, count(*) FILTER (WHERE coalesce(n, 0) > 0) AS pinned FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs, their bytes and how many are referenced."""
    refs = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    blobs = load(spark, sf_dir, "orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return blobs.agg(F.count("*").alias("blobs"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes"), F.count_if(F.col("n") > 0).alias("pinned"))


@query("SELECT l_orderkey AS hash, count(*) AS refs, greatest(count(*) FILTER (WHERE l_linestatus = 'O') - count(*) FILTER (WHERE l_returnflag = 'R'), 0) AS pinned FROM lineitem GROUP BY 1")
def ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each blob, and pins less releases, at least 0."""
    pins = F.count_if(F.col("l_linestatus") == "O") - F.count_if(F.col("l_returnflag") == "R")
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hash")).agg(F.count("*").alias("refs"), F.greatest(pins, F.lit(0)).alias("pinned"))


@query(f"WITH {TASKS} SELECT DISTINCT project FROM tasks ORDER BY project LIMIT 100")
def distinct_users_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred projects."""
    return tasks(spark, sf_dir).select("project").distinct().orderBy("project").limit(100)


@query(f"""WITH {TASKS} SELECT project, count(*) AS runs, count(*) FILTER (WHERE result_kind = 'success') AS successes, coalesce(max(at_s) FILTER (WHERE result_kind = 'success'), 0) AS last_success FROM tasks GROUP BY 1""")
def profile_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, successes and the last success of each project; 0 if it never had one."""
    ok = F.col("result_kind") == "success"
    return tasks(spark, sf_dir).groupBy("project").agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.coalesce(F.max(F.when(ok, F.col("at_s"))), F.lit(0)).alias("last_success"))


@query(f"WITH {TASKS} SELECT (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS online, (SELECT count(*) FROM tasks WHERE status = 'queued' AND project = 7) AS queued_of_project, (SELECT count(*) > 0 FROM tasks WHERE status = 'running') AS any_running")
def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single counts, as one row."""
    t = tasks(spark, sf_dir).agg(F.count_if((F.col("status") == "queued") & (F.col("project") == 7)).alias("queued_of_project"), (F.count_if(F.col("status") == "running") > 0).alias("any_running"))
    online = load(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_acctbal") > 0).alias("online")).scalar()
    return t.select(online.alias("online"), "queued_of_project", "any_running")


@query("""SELECT r_name AS arch, count(*) AS workers, count(*) FILTER (WHERE s_acctbal > 0) AS online, sum(4 + s_suppkey % 5)::BIGINT AS capacity, sum(greatest(0, 4 + s_suppkey % 5 - greatest(s_suppkey % 7, s_suppkey % 4)))::BIGINT AS free
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def fleet_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers, capacity and free slots by architecture; a worker's free slots never fall below 0."""
    w = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    slots = F.expr("4 + s_suppkey % 5")
    free = F.greatest(F.lit(0), slots - F.greatest(F.expr("s_suppkey % 7"), F.expr("s_suppkey % 4")))
    return w.groupBy(F.col("r_name").alias("arch")).agg(F.count("*").alias("workers"), F.count_if(F.col("s_acctbal") > 0).alias("online"), F.sum(slots).alias("capacity"), F.sum(free).alias("free"))


@query(f"""WITH {TASKS}, m AS (SELECT event_type AS metric, sum(k)::BIGINT AS v FROM tasks GROUP BY 1)
 SELECT metric, '# HELP ' || metric || ' total' || chr(10) || '# TYPE ' || metric || ' counter' || chr(10) || metric || ' ' || v AS text FROM m""")
def prom_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric in the text form that scrapers read."""
    m = tasks(spark, sf_dir).groupBy(F.col("event_type").alias("metric")).agg(F.sum("k").alias("v"))
    return m.select("metric", F.expr("concat('# HELP ', metric, ' total\\n# TYPE ', metric, ' counter\\n', metric, ' ', v)").alias("text"))


@query(f"WITH o AS ({ORACLES['overview_counters']}) SELECT unnest(['running', 'queued', 'total', 'success', 'compile_error', 'env_error', 'infra_error', 'cache_hits', 'bytes_synced', 'success_rate']) AS field, unnest([running, queued, total, success, compile_error, env_error, infra_error, cache_hits, bytes_synced, success_rate]::DOUBLE[]) AS value FROM o")
def overview_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview card as a JSON document, read back field by field."""
    document = overview_document(overview_counters(spark, sf_dir)).withColumn("field", F.explode(F.json_object_keys("document")))
    return document.select("field", F.element_at(F.from_json("document", "MAP<STRING, DOUBLE>"), F.col("field")).alias("value"))


def overview_document(counters: DataFrame) -> DataFrame:
    """One row, `document`: the counters as one JSON document."""
    return counters.select(F.to_json(F.struct("*")).alias("document"))


@query(f"""WITH {TASKS}, p AS (SELECT project, coalesce({_PCT.format("build_ms", 0.5)}, 0) AS p50 FROM tasks GROUP BY 1)
 SELECT t.id, CASE WHEN t.status IN ('done', 'failed', 'canceled') THEN 0 WHEN p50 = 0 THEN 60 ELSE least(greatest(CAST(round(p50 * 1.2 / 1000.0) AS BIGINT), 15), 120) END AS wait_s FROM tasks t JOIN p USING (project)""")
def suggested_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait before asking again: from the project's middle build time, from 15 to 120 seconds, 60 without history."""
    t = tasks(spark, sf_dir)
    p = nearest_ranks(t, ["project"], "build_ms", {"p50": 0.5})
    wait = F.when(F.col("status").isin("done", "failed", "canceled"), 0).when(F.col("p50").isNull(), 60)
    return t.join(p, "project", "left").select("id", wait.otherwise(F.least(F.greatest(F.round(F.col("p50") * 1.2 / 1000), F.lit(15)), F.lit(120))).cast("long").alias("wait_s"))


def stored_sketches(rows: DataFrame) -> DataFrame:
    """kind, day, n, total and sketches of users and durations: rollups that any coarser counter can be made of, as sketches merge."""
    return rows.groupBy("kind", "day").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.hll_sketch_agg("user", 14).alias("users"), F.kll_sketch_agg_bigint("ms", 400).alias("durations"))


def counters(stored: DataFrame) -> DataFrame:
    """kind and day ('*' and -1: all), n, total, users (estimated) and median (estimated) for every subset of kind and day, merged from rollups alone."""
    cube = stored.cube("kind", "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_bigint("durations").alias("durations"), F.grouping("kind").alias("_k"), F.grouping("day").alias("_d"))
    return cube.select(F.when(F.col("_k") == 1, "*").otherwise(F.col("kind")).alias("kind"), F.when(F.col("_d") == 1, -1).otherwise(F.col("day")).alias("day"), "n", "total", F.hll_sketch_estimate("users").alias("users"), F.kll_sketch_get_quantile_bigint("durations", F.lit(0.5)).alias("median"))


@query(f"""WITH {TASKS}, t AS (SELECT result_kind AS kind, at_s // 86400 AS day, build_ms AS ms FROM tasks) SELECT CASE WHEN GROUPING(kind) = 1 THEN '*' ELSE kind END AS kind, CASE WHEN GROUPING(day) = 1 THEN -1 ELSE day END AS day, count(*) AS n, sum(ms)::BIGINT AS total, true AS users_close, true AS median_close FROM t GROUP BY CUBE (kind, day)""")
def sketch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over every subset of kind and day out of stored sketches, held against exact ones: distinct users within 5 %, the median between the 46th and 54th percentile."""
    rows = tasks(spark, sf_dir).select(F.col("result_kind").alias("kind"), F.expr("at_s div 86400").alias("day"), F.col("project").alias("user"), F.col("build_ms").alias("ms"))
    stored = settled(stored_sketches(rows), "sketches")
    exact = rows.cube("kind", "day").agg(F.count_distinct("user").alias("exact"), F.percentile("ms", F.array(F.lit(0.46), F.lit(0.54))).alias("near"), F.grouping("kind").alias("_k"), F.grouping("day").alias("_d"))
    exact = exact.select(F.when(F.col("_k") == 1, "*").otherwise(F.col("kind")).alias("kind"), F.when(F.col("_d") == 1, -1).otherwise(F.col("day")).alias("day"), "exact", "near")
    close = F.abs(F.col("users") - F.col("exact")) <= F.greatest(0.05 * F.col("exact"), F.lit(1.0))
    # a quantile is one of the values, so between neighbours either may be told
    inside = (F.col("median") >= F.floor(F.element_at("near", 1))) & (F.col("median") <= F.ceil(F.element_at("near", 2)))
    few = F.col("n") < 25
    return counters(stored).join(exact, ["kind", "day"]).select("kind", "day", "n", "total", close.alias("users_close"), (few | inside).alias("median_close"))
