"""Filters, lookups, paging, ranking and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.window import Window

from ..operators.folds import first_per
from ..operators.paging import budget_prefix, page, page_per, where_given
from ..sources.telemetry import as_of, diagnostics, lines, load, tasks
from .base import DIAGS, LINES, TASKS, query

EVENTS = StructType([StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("user_id", LongType()), StructField("event_type", StringType()), StructField("value", DoubleType()), StructField("props", StringType())])


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 1")
def lookup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of one key, read with an explicit schema."""
    e = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    return e.filter("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query(f"WITH {TASKS} SELECT id, project, status FROM tasks WHERE status = 'done' AND event_type = 'click' ORDER BY at_us DESC, id DESC LIMIT 50 OFFSET 20")
def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of tasks, newest first, by whichever filters are given."""
    found = where_given(tasks(spark, sf_dir), status="done", event_type="click", project=None, worktree=None)
    return page(found, [F.desc("at_us"), F.desc("id")], 50, 20).select("id", "project", "status")


@query(f"WITH {TASKS} SELECT id, project FROM tasks WHERE status = 'queued' ORDER BY at_us, id LIMIT 200")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred tasks that have waited longest."""
    return page(tasks(spark, sf_dir).filter("status = 'queued'"), ["at_us", "id"], 200).select("id", "project")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'closed' END AS state FROM orders JOIN customer ON o_custkey = c_custkey
 WHERE o_orderstatus = 'F' AND c_mktsegment <> '' AND o_orderpriority NOT LIKE '5%' AND o_orderdate < (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders)""")
def status_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, an approval gate with an empty sentinel, staleness and a prefix to leave out."""
    o = load(spark, sf_dir, "orders")
    stale = F.col("o_orderdate") < o.agg(F.max("o_orderdate").alias("last")).scalar() - F.expr("INTERVAL 365 DAY")
    kept = o.filter((F.col("o_orderstatus") == "F") & ~F.col("o_orderpriority").startswith("5") & stale)
    return kept.join(load(spark, sf_dir, "customer").filter("c_mktsegment <> ''"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus").isin("O", "P"), "open").otherwise("closed").alias("state"))


@query(f"""WITH {DIAGS}, f AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY pos) AS place, count(*) OVER (PARTITION BY log_id) AS total FROM diags WHERE level IN ('error', 'warning') AND code = 'E7') SELECT log_id, pos, level, place, total FROM f WHERE place > 1 AND place <= 4""")
def diagnostic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics by severity and code, the second to fourth of each log."""
    d = where_given(diagnostics(spark, sf_dir), code="E7").filter(F.col("level").isin("error", "warning"))
    return page_per(d, "log_id", ["pos"], 3, 1).select("log_id", "pos", "level", "place", "total")


@query(f"""WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS place, count(*) OVER (PARTITION BY log_id) AS total FROM lines WHERE contains(lower(line), 'the')) SELECT log_id, line_no, line, total, total > 3 AS truncated FROM f WHERE place <= 3""")
def log_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines of each log that hold a needle, whatever its case, with honest totals."""
    found = lines(spark, sf_dir).filter(F.contains(F.lower("line"), F.lit("the")))
    return page_per(found, "log_id", ["line_no"], 3).select("log_id", "line_no", "line", "total", (F.col("total") > 3).alias("truncated"))


@query(f"WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no DESC) AS back FROM lines WHERE contains(lower(line), 'the')) SELECT log_id, line_no, line FROM f WHERE back <= 3")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three matching lines of each log."""
    found = lines(spark, sf_dir).filter(F.contains(F.lower("line"), F.lit("the")))
    return page_per(found, "log_id", [F.desc("line_no")], 3).select("log_id", "line_no", "line")


@query(f"WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS place, count(*) OVER (PARTITION BY log_id) AS total FROM lines) SELECT log_id, line_no, place, total FROM f WHERE place > 5 AND place <= 10")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines six to ten of each log."""
    return page_per(lines(spark, sf_dir), "log_id", ["line_no"], 5, 5).select("log_id", "line_no", "place", "total")


@query(f"""WITH {LINES}, u AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY log_id ORDER BY line_no) AS used, sum(strlen(line) + 1) OVER (PARTITION BY log_id) AS bytes FROM lines)
 SELECT log_id, count(*) FILTER (WHERE used <= 2048) AS kept, coalesce(max(used) FILTER (WHERE used <= 2048), 0)::BIGINT AS used, (any_value(bytes) - coalesce(max(used) FILTER (WHERE used <= 2048), 0))::BIGINT AS omitted FROM u GROUP BY 1""")
def log_budget_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each log's first lines fit 2048 bytes, and the bytes left out."""
    size = F.octet_length("line") + 1
    every = lines(spark, sf_dir)
    kept = budget_prefix(every, "log_id", ["line_no"], size, 2048).groupBy("log_id").agg(F.count("*").alias("kept"), F.max("used").alias("used"))
    sums = every.groupBy("log_id").agg(F.sum(size).alias("bytes"))
    used = F.coalesce("used", F.lit(0))
    return sums.join(kept, "log_id", "left").select("log_id", F.coalesce("kept", F.lit(0)).alias("kept"), used.cast("long").alias("used"), (F.col("bytes") - used).alias("omitted"))


@query(f"""WITH {DIAGS}, r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, pos) AS place, count(*) OVER (PARTITION BY log_id) AS n FROM diags) SELECT log_id, pos, level, greatest(n - 5, 0) AS truncated FROM r WHERE place <= 5""")
def top_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five gravest diagnostics of each log, in their order, and how many were cut."""
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warning", 1).otherwise(2)
    return page_per(diagnostics(spark, sf_dir), "log_id", [rank, "pos"], 5).select("log_id", "pos", "level", F.greatest(F.col("total") - 5, F.lit(0)).alias("truncated"))


@query(f"""WITH {DIAGS}, e AS (SELECT *, pos % 2 = 1 AS is_new FROM diags WHERE level = 'error'), n AS (SELECT DISTINCT log_id, message FROM e WHERE is_new), r AS (SELECT e.* FROM e WHERE is_new OR NOT EXISTS (SELECT 1 FROM n WHERE n.log_id = e.log_id AND n.message = e.message)),
 p AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY is_new DESC, pos) AS place, count(*) OVER (PARTITION BY log_id) AS n FROM r) SELECT log_id, pos, is_new, greatest(n - 4, 0) AS hidden FROM p WHERE place <= 4""")
def errors_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New errors, then others that don't repeat one, four of each log; and how many are hidden."""
    e = diagnostics(spark, sf_dir).filter("level = 'error'").withColumn("is_new", F.col("pos") % 2 == 1)
    new = e.filter("is_new")
    rest = e.filter("not is_new").join(new.select("log_id", "message").distinct(), ["log_id", "message"], "left_anti").select(*e.columns)
    return page_per(new.unionByName(rest), "log_id", [F.desc("is_new"), "pos"], 4).select("log_id", "pos", "is_new", F.greatest(F.col("total") - 4, F.lit(0)).alias("hidden"))


@query(f"""WITH {DIAGS}, c AS (SELECT log_id, CASE WHEN code = '' THEN 'other' ELSE code END AS code, count(*) AS n FROM diags WHERE level = 'warning' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY code) AS rn FROM c) SELECT log_id, code, n FROM r WHERE rn <= 5""")
def warning_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings counted by code; the five codes that sort first."""
    c = diagnostics(spark, sf_dir).filter("level = 'warning'").groupBy("log_id", F.when(F.col("code") == "", "other").otherwise(F.col("code")).alias("code")).agg(F.count("*").alias("n"))
    return page_per(c, "log_id", ["code"], 5).select("log_id", "code", "n")


@query("""WITH p AS (SELECT *, lower(p_name || ' ' || p_brand || ' ' || p_type) AS hay, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM part)
 SELECT p_partkey, rank FROM p WHERE contains(hay, 'red') AND contains(hay, 'brand#1') AND (p_size % 2 = 0 OR p_size > 25) ORDER BY rank, p_retailprice DESC, p_partkey LIMIT 40""")
def env_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments whose texts hold every word asked for, by status and then by how lately they worked."""
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    words = F.split(F.lit("red brand#1"), " ")
    rank = F.when(F.col("p_size") % 4 == 0, 0).when(F.col("p_size") % 4 == 1, 1).otherwise(2)
    found = load(spark, sf_dir, "part").withColumn("hay", hay).filter(F.forall(words, lambda w: F.contains(F.col("hay"), w)) & ((F.col("p_size") % 2 == 0) | (F.col("p_size") > 25)))
    return page(found.withColumn("rank", rank), ["rank", F.desc("p_retailprice"), "p_partkey"], 40).select("p_partkey", "rank")


@query("SELECT p_type AS adapter, coalesce(arg_max(p_partkey, (p_retailprice + CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END, -p_partkey)) FILTER (WHERE p_size % 3 <> 0), -1) AS image FROM part GROUP BY 1")
def default_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default image of each adapter: of the healthy ones, the one of highest score, the first of equals; -1 if there is none."""
    score = F.col("p_retailprice") + F.when(F.col("p_name").contains("ring"), 1).otherwise(0)
    best = F.max_by("p_partkey", F.when(F.col("p_size") % 3 != 0, F.struct(score, -F.col("p_partkey"))))
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("adapter")).agg(F.when(F.count_if(F.col("p_size") % 3 != 0) > 0, best).otherwise(F.lit(-1)).alias("image"))


@query("(SELECT 'commit' AS list, event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) UNION ALL (SELECT 'audit', event_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 50) UNION ALL (SELECT 'alert', event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 30)")
def capped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commits, audit rows and alerts."""
    t = tasks(spark, sf_dir)
    newest = [F.desc("at_us"), F.desc("id")]
    part = lambda name, rows, n: page(rows, newest, n).select(F.lit(name).alias("list"), "id")
    return part("commit", t, 20).unionAll(part("audit", t.filter("event_type = 'signup'"), 50)).unionAll(part("alert", t.filter("event_type = 'error'"), 30))


_UPS = f"{TASKS}, u AS (SELECT project AS key, id, at_us, CASE WHEN k % 3 = 0 THEN '' ELSE event_type END AS name, CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS n FROM tasks)"


def _upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks(spark, sf_dir)
    return t.select(F.col("project").alias("key"), "id", "at_us", F.when(F.col("k") % 3 == 0, "").otherwise(F.col("event_type")).alias("name"), F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("k")).alias("n"))


@query(f"WITH {_UPS} SELECT key, arg_max(name, (at_us, id)) AS name, arg_max(n, (at_us, id)) AS n FROM u GROUP BY 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key wins."""
    return first_per(_upserts(spark, sf_dir), ["key"], [F.desc("at_us"), F.desc("id")]).select("key", "name", "n")


@query(f"WITH {_UPS} SELECT key, coalesce(arg_max(name, (at_us, id)) FILTER (WHERE name <> ''), '') AS name, coalesce(arg_max(n, (at_us, id)) FILTER (WHERE n <> 0), 0) AS n FROM u GROUP BY 1")
def upsert_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write wins column by column, and an empty text or 0 never overwrites."""
    u = _upserts(spark, sf_dir)
    last = lambda c, given: F.max_by(F.when(given, F.col(c)), F.when(given, F.struct("at_us", "id")))
    return u.groupBy("key").agg(F.coalesce(last("name", F.col("name") != ""), F.lit("")).alias("name"), F.coalesce(last("n", F.col("n") != 0), F.lit(0)).alias("n"))


@query(f"""WITH {TASKS} SELECT id, CASE WHEN status = 'queued' AND at_us <= us - 1800000000 THEN 'canceled' ELSE status END AS status FROM tasks, now WHERE NOT (status = 'failed' AND at_us < us - 604800000000)""")
def prune_and_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tasks older than a week go; queued ones older than half an hour are canceled."""
    t = tasks(spark, sf_dir)
    now = as_of(t)
    kept = t.filter(~((F.col("status") == "failed") & (F.col("at_us") < now - 604_800_000_000)))
    return kept.select("id", F.when((F.col("status") == "queued") & (F.col("at_us") <= now - 1_800_000_000), "canceled").otherwise(F.col("status")).alias("status"))


@query("""SELECT p_partkey, left(sha256(p_name), 8) || '…' AS masked, split_part(split_part(p_name || ':' || p_brand, '@', 1), ':', 1) || '@' || left(sha256(p_brand), 12) AS full_ref FROM part""")
def masked_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens cut to eight characters, and image names with their digests in place of tags."""
    base = F.substring_index(F.substring_index(F.concat("p_name", F.lit(":"), "p_brand"), "@", 1), ":", 1)
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(F.left(F.sha2("p_name", 256), F.lit(8)), F.lit("…")).alias("masked"), F.concat(base, F.lit("@"), F.left(F.sha2("p_brand", 256), F.lit(12))).alias("full_ref"))


@query("""SELECT p_partkey AS id, regexp_matches(sha256(p_name), '^[0-9a-f]{64}$') AS hash_ok, regexp_matches(p_brand, '^[A-Za-z0-9_-]{1,64}$') AS id_ok, regexp_matches(upper(replace(p_name, ' ', '_')), '^[A-Z_][A-Z0-9_]*$') AND strlen(p_name) <= 4096 AND upper(p_name) NOT LIKE 'RED%' AS env_ok FROM part""")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether hashes, ids and environment keys have the shapes they must have."""
    key = F.upper(F.regexp_replace("p_name", " ", "_"))
    env = key.rlike("^[A-Z_][A-Z0-9_]*$") & (F.octet_length("p_name") <= 4096) & ~F.upper("p_name").startswith("RED")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).rlike("^[0-9a-f]{64}$").alias("hash_ok"), F.col("p_brand").rlike("^[A-Za-z0-9_-]{1,64}$").alias("id_ok"), env.alias("env_ok"))


# Keys that a request's environment may not set, and the prefix of others.
DENIED = ["PATH", "HOME", "RUSTC_WRAPPER", "CARGO_HOME", "RUSTUP_HOME", "CARGO_TARGET_DIR"]
DENIED_PREFIX = "SCCACHE_"
#: Entries of a request, and bytes of a value.
ENTRIES, VALUE_BYTES = 32, 4096
_KEYS = ["A_1", "PATH", "SCCACHE_DIR", "1A", "A-B", "", "_x", "path", "HOME2", "CARGO_HOME", "Ä"]


def entry_error(key: Column, value: Column, place: Column) -> Column:
    """The first rule that an entry of a request's environment breaks, or an empty text; keys are compared as they stand."""
    return (
        F.when(place > ENTRIES, "too_many").when(~key.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "bad_name").when(key.isin(DENIED) | key.startswith(DENIED_PREFIX), "denied")
        .when(F.octet_length(value) > VALUE_BYTES, "too_long").otherwise("")
    )


@query(f"""WITH e AS (SELECT o_orderkey AS id, o_orderkey % {len(_KEYS)} AS form, CASE WHEN o_orderkey % 13 = 0 THEN 4098 WHEN o_orderkey % 13 = 1 THEN 4096 ELSE 1 END AS bytes, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rn FROM orders)
 SELECT id, CASE WHEN rn > {ENTRIES} THEN 'too_many' WHEN form IN (3, 4, 5, 10) THEN 'bad_name' WHEN form IN (1, 2, 9) THEN 'denied' WHEN bytes > {VALUE_BYTES} THEN 'too_long' ELSE '' END AS reason FROM e""")
def env_key_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that an environment entry breaks, or none; a request is that of one of twenty customers."""
    n = F.col("o_orderkey")
    rn = F.row_number().over(Window.partitionBy(F.col("o_custkey") % 20).orderBy("o_orderkey"))
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (n % len(_KEYS)).cast("int") + 1)
    value = F.when(n % 13 == 0, F.repeat(F.lit("é"), 2049)).when(n % 13 == 1, F.repeat(F.lit("é"), 2048)).otherwise("x")
    return load(spark, sf_dir, "orders").select(n.alias("id"), entry_error(key, value, rn).alias("reason"))
