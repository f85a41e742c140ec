"""Joins: collection of cold blobs, missing and known blobs, merges, baselines, prefixes and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.matching import latest_before, longest_prefix, overlapping
from ..sources.telemetry import as_of, load, paths, tasks
from .base import PATHS, TASKS, query

_BLOBS = "b AS (SELECT o_orderkey AS hash, CAST(floor(o_totalprice) AS BIGINT) AS size, epoch_us(o_orderdate) // 1000000 AS last_used, o_orderkey % 9 = 0 AS pinned FROM orders), bnow AS (SELECT max(last_used) AS s FROM b)"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blobs out of orders."""
    used = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hash"), F.floor("o_totalprice").cast("long").alias("size"), used.alias("last_used"), (F.col("o_orderkey") % 9 == 0).alias("pinned"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to blobs out of line items."""
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash"))


def cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that nothing pins or references and that weren't used for thirty days."""
    b = blobs(spark, sf_dir)
    old = b.filter(~F.col("pinned") & (F.col("last_used") < as_of(b, "last_used") - 30 * 86_400))
    return old.join(refs(spark, sf_dir), "hash", "left_anti")


_COLD = f"{_BLOBS}, cold AS (SELECT b.* FROM b, bnow WHERE NOT pinned AND last_used < s - 30 * 86400 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = hash))"


@query(f"WITH {_COLD} SELECT hash, size, last_used FROM cold ORDER BY last_used, hash LIMIT 500")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five hundred coldest blobs that may go."""
    return cold(spark, sf_dir).select("hash", "size", "last_used").orderBy("last_used", "hash").limit(500)


@query(f"WITH {_COLD} SELECT count(*) AS deleted, coalesce(sum(CASE WHEN hash % 4 = 0 THEN greatest(size, 0) ELSE size + 1 END), 0)::BIGINT AS bytes FROM cold")
def gc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blobs go and their bytes: the actual size where it is known, else the recorded one."""
    actual = F.when(F.col("hash") % 4 != 0, F.col("size") + 1)
    return cold(spark, sf_dir).agg(F.count("*").alias("deleted"), F.coalesce(F.sum(F.coalesce(actual, F.greatest("size", F.lit(0)))), F.lit(0)).alias("bytes"))


@query("SELECT DISTINCT l_orderkey + 7 AS hash FROM lineitem WHERE l_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders)")
def blobs_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes asked for that the store lacks."""
    asked = refs(spark, sf_dir).select((F.col("hash") + 7).alias("hash")).distinct()
    return asked.join(blobs(spark, sf_dir), "hash", "left_anti")


@query("SELECT DISTINCT l_orderkey + 7 AS hash FROM lineitem WHERE l_orderkey + 7 IN (SELECT o_orderkey FROM orders)")
def blobs_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes asked for that the store has."""
    asked = refs(spark, sf_dir).select((F.col("hash") + 7).alias("hash")).distinct()
    return asked.join(blobs(spark, sf_dir), "hash", "left_semi")


@query(f"""WITH {_BLOBS}, a AS (SELECT DISTINCT l_orderkey + 3 AS hash FROM lineitem) SELECT a.hash, CASE WHEN last_used > s - 7 * 86400 * 52 THEN 'known' ELSE 'ask' END AS action
 FROM a CROSS JOIN bnow LEFT JOIN b USING (hash)""")
def known_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes known for less than a year needn't be asked about; the others must."""
    b = blobs(spark, sf_dir)
    asked = refs(spark, sf_dir).select((F.col("hash") + 3).alias("hash")).distinct()
    fresh = F.col("last_used") > as_of(b, "last_used") - 7 * 86_400 * 52
    return asked.join(b, "hash", "left").select("hash", F.when(fresh, "known").otherwise("ask").alias("action"))


@query(f"""WITH {TASKS}, a AS (SELECT project, list_sort(list(DISTINCT worktree) FILTER (WHERE status = 'done')) AS d, list_sort(list(DISTINCT worktree) FILTER (WHERE status = 'failed')) AS f FROM tasks GROUP BY 1)
 SELECT project, array_to_string(list_sort(list_intersect(coalesce(d, []), coalesce(f, []))), ',') AS grants FROM a""")
def grant_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants in force now that were in force then."""
    per = tasks(spark, sf_dir).groupBy("project").agg(F.collect_set(F.when(F.col("status") == "done", F.col("worktree"))).alias("d"), F.collect_set(F.when(F.col("status") == "failed", F.col("worktree"))).alias("f"))
    return per.select("project", F.array_join(F.array_sort(F.array_intersect("d", "f")), ",").alias("grants"))


@query("""SELECT s.s_suppkey AS worker, CASE WHEN l.s_suppkey IS NULL THEN 'offline' ELSE 'online' END AS status, coalesce(l.s_acctbal, 0.0) AS load, s.s_name AS name
 FROM supplier s LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) l ON s.s_suppkey = l.s_suppkey""")
def workers_live_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolled workers with what the live registry says of them."""
    all_ = load(spark, sf_dir, "supplier")
    live = all_.filter("s_suppkey % 3 <> 0").select("s_suppkey", F.col("s_acctbal").alias("load"), F.lit("online").alias("status"))
    return all_.join(live, "s_suppkey", "left").select(F.col("s_suppkey").alias("worker"), F.coalesce("status", F.lit("offline")).alias("status"), F.coalesce("load", F.lit(0.0)).alias("load"), F.col("s_name").alias("name"))


@query(f"""WITH {TASKS} SELECT id, last_value(CASE WHEN status = 'done' THEN id END IGNORE NULLS) OVER (PARTITION BY project, worktree, event_type ORDER BY at_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM tasks""")
def baseline_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each task, the last finished one before it of the same project, worktree and type."""
    base = latest_before(tasks(spark, sf_dir), ["project", "worktree", "event_type"], ["at_us", "id"], F.col("status") == "done", F.col("id"))
    return tasks(spark, sf_dir).select("id", base.alias("base"))


@query(f"""WITH {TASKS} SELECT DISTINCT o.id AS superseded, n.id AS by_id FROM tasks o JOIN tasks n ON o.project = n.project AND o.worktree = n.worktree AND o.event_type = n.event_type
 WHERE o.status = 'queued' AND n.status = 'queued' AND n.id = (SELECT max(m.id) FROM tasks m WHERE m.status = 'queued' AND m.project = o.project AND m.worktree = o.worktree AND m.event_type = o.event_type) AND o.id < n.id""")
def supersede_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued tasks that a later queued one of the same key makes needless."""
    queued = tasks(spark, sf_dir).filter("status = 'queued'")
    newest = F.max("id").over(Window.partitionBy("project", "worktree", "event_type"))
    return queued.select(F.col("id").alias("superseded"), newest.alias("by_id")).filter("superseded < by_id")


@query(f"""WITH {PATHS}, own(owner) AS (SELECT '' UNION SELECT DISTINCT split_part(path, '/', 1) FROM paths WHERE page_id % 2 = 0), j AS (SELECT page_id, path, owner FROM paths JOIN own ON owner = '' OR path = owner OR starts_with(path, owner || '/'))
 SELECT page_id, arg_max(owner, length(owner)) AS owner FROM j GROUP BY 1""")
def scope_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package that owns each path; the root package owns what no other does."""
    p = paths(spark, sf_dir)
    owners = p.filter("page_id % 2 = 0").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("owner")).distinct().unionAll(spark.createDataFrame([("",)], "owner string"))
    return longest_prefix(p.select("page_id", "path"), "path", owners, "owner", ["page_id"]).select("page_id", "owner")


@query(f"""WITH {PATHS}, own(owner) AS (SELECT DISTINCT host FROM paths WHERE page_id % 3 = 0 UNION SELECT DISTINCT host || '/' || split_part(path, '/', 1) FROM paths WHERE page_id % 3 = 1 AND path <> ''),
 j AS (SELECT page_id, owner, length(url) AS n FROM paths JOIN own ON host || '/' || path = owner OR starts_with(host || '/' || path, owner || '/')), b AS (SELECT page_id, arg_max(owner, length(owner)) AS owner, any_value(n) AS n FROM j GROUP BY 1)
 SELECT owner, count(*) AS files, sum(n)::BIGINT AS bytes FROM b GROUP BY 1""")
def root_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of each root; where roots lie in one another, the deepest one owns."""
    p = paths(spark, sf_dir)
    first = F.split_part("path", F.lit("/"), F.lit(1))
    owners = p.filter("page_id % 3 = 0").select(F.col("host").alias("owner")).unionAll(p.filter("page_id % 3 = 1 AND path <> ''").select(F.concat_ws("/", "host", first).alias("owner"))).distinct()
    rows = p.select("page_id", F.concat("host", F.lit("/"), "path").alias("full"), F.length("url").alias("n"))
    owned = longest_prefix(rows, "full", owners, "owner", ["page_id"]).filter("owner is not null")
    return owned.groupBy("owner").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("bytes"))


@query("""WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn, count(*) OVER (PARTITION BY l_partkey) AS users FROM d)
 SELECT p_partkey AS image, coalesce(max(users), 0) AS users, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) FILTER (WHERE rn <= 5), '') AS first_users FROM part LEFT JOIN r ON p_partkey = l_partkey GROUP BY 1""")
def image_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many use each image, and the first five of them."""
    pairs = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    first = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_suppkey"))).filter("rn <= 5")
    names = F.array_join(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",")
    used = pairs.groupBy("l_partkey").agg(F.count("*").alias("users")).join(first.groupBy("l_partkey").agg(names.alias("first_users")), "l_partkey")
    out = load(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left")
    return out.select(F.col("p_partkey").alias("image"), F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("first_users", F.lit("")).alias("first_users"))


@query("""WITH q AS (SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_name || ' ' || p_brand ELSE left(p_name, 8) END AS q FROM part),
 m AS (SELECT qid, p_partkey, 1 AS tier FROM q JOIN part ON q = p_partkey::VARCHAR UNION ALL SELECT qid, p_partkey, 2 FROM q JOIN part ON q = p_name || ' ' || p_brand UNION ALL SELECT qid, p_partkey, 3 FROM q JOIN part ON length(q) >= 8 AND left(p_name, 8) = q),
 t AS (SELECT qid, min(tier) AS tier FROM m GROUP BY 1), c AS (SELECT m.qid, count(*) AS n, min(p_partkey) AS one FROM m JOIN t ON m.qid = t.qid AND m.tier = t.tier GROUP BY 1)
 SELECT q.qid, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN one END AS image FROM q LEFT JOIN c ON q.qid = c.qid""")
def ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved by id, else by full name, else by a prefix of eight characters; ambiguous ones stay open."""
    part = load(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_name", "p_brand")
    asked = part.select(F.col("p_partkey").alias("qid"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 4 == 1, full).otherwise(F.left("p_name", F.lit(8))).alias("q"))
    ways = [(F.col("p_partkey").cast("string"), 1), (full, 2), (F.when(F.length("p_name") >= 8, F.left("p_name", F.lit(8))), 3)]
    # counted by key before they meet the questions, as a name may stand for many images
    names = None
    for key, tier in ways:
        one = part.groupBy(key.alias("q")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("one")).withColumn("tier", F.lit(tier)).filter("q is not null")
        names = one if names is None else names.unionAll(one)
    best = names.groupBy("q").agg(F.min_by(F.struct("n", "one"), "tier").alias("m"))
    out = asked.join(best, "q", "left")
    return out.select("qid", F.when(F.col("m.n") == 1, "one").when(F.col("m.n") > 1, "ambiguous").otherwise("none").alias("outcome"), F.when(F.col("m.n") == 1, F.col("m.one")).alias("image"))


@query("""SELECT c_custkey AS project, coalesce(t.p_name, 'default') AS image, CASE WHEN t.p_partkey IS NOT NULL THEN 'own' ELSE 'fallback' END AS source
 FROM customer LEFT JOIN (SELECT * FROM part WHERE p_size % 3 <> 0) t ON c_custkey = t.p_partkey""")
def image_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's own image if its digest is trusted, else the default."""
    trusted = load(spark, sf_dir, "part").filter("p_size % 3 <> 0")
    out = load(spark, sf_dir, "customer").join(trusted, F.col("c_custkey") == F.col("p_partkey"), "left")
    return out.select(F.col("c_custkey").alias("project"), F.coalesce("p_name", F.lit("default")).alias("image"), F.when(F.col("p_partkey").isNotNull(), "own").otherwise("fallback").alias("source"))


@query(f"""WITH {PATHS}, r AS (SELECT DISTINCT host || '/' || path AS root FROM paths WHERE path <> '' AND page_id % 2 = 0), o AS (SELECT a.root FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE starts_with(a.root, b.root || '/'))),
 c(dir) AS (SELECT DISTINCT host FROM paths WHERE page_id % 5 < 2) SELECT root, EXISTS (SELECT 1 FROM c WHERE root = dir OR starts_with(root, dir || '/')) AS allowed FROM o""")
def consent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outermost roots, and whether each lies in a directory that consent was given for."""
    p = paths(spark, sf_dir)
    roots = p.filter("path <> '' AND page_id % 2 = 0").select(F.concat_ws("/", "host", "path").alias("root")).distinct()
    dirs = p.filter("page_id % 5 < 2").select(F.col("host").alias("dir")).distinct()
    inside = roots.select("root", F.explode(_parents(F.col("root"))).alias("up")).join(roots.select(F.col("root").alias("up")), "up", "left_semi").select("root").distinct()
    outer = roots.join(inside, "root", "left_anti")
    allowed = outer.select("root", F.explode(F.concat(_parents(F.col("root")), F.array("root"))).alias("dir")).join(dirs, "dir", "left_semi").select("root", F.lit(True).alias("ok")).distinct()
    return outer.join(allowed, "root", "left").select("root", F.coalesce("ok", F.lit(False)).alias("allowed"))


def _parents(path):
    """Proper prefixes of a path, without the empty one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


@query(f"""WITH {TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY project, worktree ORDER BY at_us, id) AS n FROM tasks) SELECT a.id AS first_id, b.id AS retry_id, coalesce(b.result_kind, a.result_kind) AS outcome
 FROM r a LEFT JOIN r b ON a.project = b.project AND a.worktree = b.worktree AND b.n = a.n + 1 AND a.result_kind = 'infra_error' WHERE a.result_kind = 'infra_error'""")
def retry_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task that failed for the fleet's fault, with the run after it, whose outcome counts."""
    w = Window.partitionBy("project", "worktree").orderBy("at_us", "id")
    t = tasks(spark, sf_dir).withColumn("retry_id", F.lead("id").over(w)).withColumn("again", F.lead("result_kind").over(w))
    return t.filter("result_kind = 'infra_error'").select(F.col("id").alias("first_id"), "retry_id", F.coalesce("again", "result_kind").alias("outcome"))


#: Seconds without a report after which a worker is silent, seconds of a bin, and the workers that events stand for: half of them come from one.
QUIET, BIN, WORKERS = 3600, 7200, 9


@query(f"""WITH {TASKS}, w AS (SELECT id, CASE WHEN project % 2 = 0 THEN 0 ELSE project % {WORKERS} END AS worker, at_s, build_ms FROM tasks), s AS (SELECT worker, at_s AS quiet, lead(at_s) OVER (PARTITION BY worker ORDER BY at_s, id) AS heard FROM w WHERE id % 5 = 0),
 q AS (SELECT * FROM s WHERE heard - quiet > {QUIET}) SELECT id, w.worker, quiet, heard, least(at_s + build_ms // 10, heard) - greatest(at_s, quiet) AS seconds FROM w JOIN q ON q.worker = w.worker AND at_s < heard AND quiet < at_s + build_ms // 10 AND build_ms >= 10""")
def silent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that ran while their worker was silent, with that span and for how many seconds; every fifth event is a report of its worker."""
    t = tasks(spark, sf_dir).withColumn("worker", F.when(F.col("project") % 2 == 0, 0).otherwise(F.col("project") % WORKERS))
    heard = F.lead("at_s").over(Window.partitionBy("worker").orderBy("at_s", "id"))
    quiet = t.filter("id % 5 = 0").select("worker", F.col("at_s").alias("r_from"), heard.alias("r_to")).filter(F.col("r_to") - F.col("r_from") > QUIET)
    ran = t.select("id", "worker", F.col("at_s").alias("from_at"), F.expr("at_s + build_ms div 10").alias("to_at"))
    both = overlapping(ran, quiet, "worker", BIN)
    return both.select("id", "worker", F.col("r_from").alias("quiet"), F.col("r_to").alias("heard"), (F.least("to_at", "r_to") - F.greatest("from_at", "r_from")).alias("seconds"))
