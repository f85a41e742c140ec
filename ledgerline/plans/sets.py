"""Sets and bags over snapshots: manifests, diagnostic deltas, rebuild plans and reconciliations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import human_bytes, length_prefixed, normalized_span
from ..operators.matching import bag_sides
from ..sources.stores import blob_path, fetch_blobs, held, insert_absent, listed_files, settled, shared_path, store_blobs
from ..sources.telemetry import as_of, diagnostics, load, paths, tasks
from .base import DIAGS, PATHS, TASKS, query

# two snapshots of the documents: the later one lost every seventh, changed every fifth and has some of its own
_SNAP = """before AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash, n_chars AS size FROM documents WHERE doc_id % 11 <> 0),
 after AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(coalesce(text, '') || '!') ELSE sha256(coalesce(text, '')) END AS hash, n_chars AS size FROM documents WHERE doc_id % 7 <> 0)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    before = docs.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(text, 256).alias("hash"), F.col("n_chars").alias("size"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(text, F.lit("!"))).otherwise(text)
    return before, docs.filter("doc_id % 7 <> 0").select("doc_id", F.sha2(changed, 256).alias("hash"), F.col("n_chars").alias("size"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots side by side, over the union of their paths."""
    a, b = _snapshots(spark, sf_dir)
    return a.withColumnRenamed("hash", "h0").withColumnRenamed("size", "s0").join(b.withColumnRenamed("hash", "h1").withColumnRenamed("size", "s1"), "doc_id", "full_outer")


@query(f"WITH {_SNAP} SELECT doc_id, CASE WHEN a.hash IS NULL THEN 'appeared' WHEN b.hash IS NULL THEN 'vanished' ELSE 'changed' END AS change FROM before a FULL OUTER JOIN after b USING (doc_id) WHERE a.hash IS DISTINCT FROM b.hash")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that appeared, vanished or changed between two scans."""
    both = _compared(spark, sf_dir).filter(~F.col("h0").eqNullSafe(F.col("h1")))
    return both.select("doc_id", F.when(F.col("h0").isNull(), "appeared").when(F.col("h1").isNull(), "vanished").otherwise("changed").alias("change"))


#: Times that a scan is taken again while files change under it.
RETRIES = 3


def stable_scan(scan: Callable[[int], DataFrame], retries: int = RETRIES) -> tuple[int, bool, DataFrame]:
    """Scan (path, hash) until two scans in a row are equal, `retries` times at most after the first; give the scans taken, whether they settled, and the last one."""
    last = scan(0)
    for n in range(1, retries + 1):
        now = scan(n)
        changed = last.withColumnRenamed("hash", "_h").join(now, "path", "full_outer").filter(~F.col("hash").eqNullSafe(F.col("_h")))
        if changed.isEmpty():
            return n + 1, True, now
        last = now
    return retries + 1, False, last


@query("SELECT 4 AS scans, true AS stable, count(*) AS files, sum(CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END)::BIGINT AS revisions FROM documents")
def snapshot_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of files that a writer still changes, every seventh twice, until a scan equals the one before."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"))
    revision = lambda n: F.when(F.col("path") % 7 == 0, min(n, 2)).otherwise(0)
    scans, stable, last = stable_scan(lambda n: docs.select("path", revision(n).alias("hash")))
    return last.agg(F.lit(scans).alias("scans"), F.lit(stable).alias("stable"), F.count("*").alias("files"), F.sum("hash").alias("revisions"))


_HASHED = "h AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash, strlen(coalesce(text, '')) AS bytes FROM documents)"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Where a store lies that documents of even number were put into; one in sixteen of them went bad since."""
    docs = load(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    bad = F.substring("hash", 64, 1) == "7"
    path = shared_path(spark, "store")
    store_blobs(docs.dropDuplicates(["hash"]).select("hash", F.when(bad, F.concat(F.lit("?"), "text")).otherwise(F.col("text")).cast("binary").alias("content")), path)
    return path


@query(f"WITH {_HASHED} SELECT doc_id, left(hash, 2) || '/' || substr(hash, 3, 2) || '/' || hash AS path, EXISTS (SELECT 1 FROM h s WHERE s.hash = h.hash AND s.doc_id % 2 = 0) AS stored FROM h")
def blob_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's blob lies, and whether the store has one of that hash."""
    blobs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    listing = spark.read.schema("hash string, shard string").parquet(_stored(spark, sf_dir)).select("hash", F.lit(True).alias("stored"))
    return blobs.join(listing, "hash", "left").select("doc_id", blob_path(F.col("hash")).alias("path"), F.coalesce("stored", F.lit(False)).alias("stored"))


@query(f"WITH {_HASHED}, w AS (SELECT DISTINCT hash, bytes FROM h WHERE doc_id % 3 = 0) SELECT hash, bytes FROM w WHERE right(hash, 1) <> '7' AND hash IN (SELECT hash FROM h WHERE doc_id % 2 = 0)")
def blob_gets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs asked for by hash that the store has and whose content is still what the hash says, with their sizes."""
    wanted = load(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return fetch_blobs(wanted, _stored(spark, sf_dir)).select("hash", F.octet_length("content").cast("long").alias("bytes"))


@query(f"WITH {_HASHED}, s AS (SELECT DISTINCT hash, bytes + CASE WHEN right(hash, 1) = '7' THEN 1 ELSE 0 END AS bytes FROM h WHERE doc_id % 2 = 0) SELECT left(hash, 2) AS shard, count(*) AS blobs, sum(bytes)::BIGINT AS bytes, true AS on_disk FROM s GROUP BY 1")
def store_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs and bytes of each shard of the store, and whether the files that its folder lists hold anything."""
    path = _stored(spark, sf_dir)
    sums = spark.read.schema("content binary, shard string").parquet(path).groupBy("shard").agg(F.count("*").alias("blobs"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))
    files = listed_files(spark, path).groupBy(F.regexp_extract("path", "shard=([0-9a-f]+)/", 1).alias("shard")).agg((F.sum("length") > 0).alias("on_disk"))
    return sums.join(files, "shard", "left").na.fill(False, ["on_disk"])


@query("SELECT hash, bytes, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(coalesce(text, '')) AS hash, strlen(coalesce(text, '')) AS bytes FROM documents) GROUP BY 1, 2")
def blob_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of blobs after two uploads, of odd documents and then of all: each content is there once, under the document that brought it first."""
    docs = load(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "doc_id")
    first = lambda rows: rows.groupBy("hash", "bytes").agg(F.min("doc_id").alias("doc_id"))
    path, schema = shared_path(spark, "blobs"), "hash string, bytes long, doc_id long, shard string"
    for rows in (first(docs).filter("doc_id % 2 = 1"), first(docs)):
        insert_absent(rows.withColumn("shard", F.substring("hash", 1, 1)), path, schema, ["shard", "hash"], ["shard"])
    return held(spark, path, schema).drop("shard")


@query(f"WITH {_SNAP} SELECT doc_id, CASE WHEN b.hash IS NULL THEN 'delete' WHEN a.hash IS NULL THEN 'fetch' WHEN a.hash <> b.hash THEN 'fetch' WHEN doc_id % 13 = 0 THEN 'relink' ELSE 'keep' END AS action FROM before a FULL OUTER JOIN after b USING (doc_id)")
def rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What turns the workspace on disk into that of the manifest."""
    action = F.when(F.col("h1").isNull(), "delete").when(F.col("h0").isNull() | (F.col("h0") != F.col("h1")), "fetch").when(F.col("doc_id") % 13 == 0, "relink").otherwise("keep")
    return _compared(spark, sf_dir).select("doc_id", action.alias("action"))


@query("""WITH c AS (SELECT source, doc_id // 1024 AS chunk, count(*) AS n, sha256(string_agg(doc_id || ' ' || n_chars || ' ' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2),
 d AS (SELECT source, chunk // 1024 AS chunk, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS h FROM c GROUP BY 1, 2),
 e AS (SELECT source, chunk // 1024 AS chunk, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS h FROM d GROUP BY 1, 2)
 SELECT source, sum(n)::BIGINT AS files, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS root FROM e GROUP BY 1""")
def manifest_root_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of each source's entries that doesn't depend on their order: a tree of hashes, each over 1024 of the level below.

    So no task gathers more than 1024 hashes for one node, for ids up to 2 ** 40.
    """
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    level = load(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("at"), F.lit(1).cast("long").alias("n"), line.alias("x"))
    gathered = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]), "\n"), 256)
    for _ in range(3):
        level = level.groupBy("source", F.expr("at div 1024").alias("up")).agg(F.sum("n").alias("n"), gathered.alias("x")).withColumnRenamed("up", "at")
    return level.groupBy("source").agg(F.sum("n").alias("files"), gathered.alias("root"))


@query("SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, sum(CASE WHEN doc_id % 3 <> 0 THEN strlen(text) ELSE 0 END)::BIGINT AS dirty_bytes FROM documents")
def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes in store, and the bytes that the baseline doesn't cover."""
    size = F.octet_length("text")
    return load(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.coalesce(F.sum(F.when(F.col("doc_id") % 3 != 0, size)), F.lit(0)).alias("dirty_bytes"))


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS declared FROM documents)
 SELECT hash, min(doc_id) AS doc_id FROM d WHERE hash = declared AND hash NOT IN (SELECT hash FROM d WHERE doc_id % 4 = 0) GROUP BY 1""")
def verified_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose content has the declared hash and isn't in store yet, each content once."""
    docs = load(spark, sf_dir, "documents")
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    good = hashed.filter(F.col("hash") == F.when(F.col("doc_id") % 17 == 0, "x").otherwise(F.col("hash")))
    return good.join(hashed.filter("doc_id % 4 = 0").select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(message, '[A-Za-z0-9_./-]+\\.rs:[0-9]+(:[0-9]+)?', '', 'g'), ':[0-9]+:[0-9]+', '', 'g'), '\\s+', ' ', 'g'))"
_DELTA = f"""{DIAGS}, k AS (SELECT *, sha256(level || chr(0) || code || chr(0) || {_KEY}) AS key FROM diags),
 c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY log_id, pos) AS nth FROM k WHERE log_id % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY log_id, pos) AS nth FROM k WHERE log_id % 2 = 1),
 delta AS (SELECT log_id, pos, level, code, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.key = c.key AND b.nth = c.nth) THEN 'preexisting' ELSE 'new' END AS side FROM c
 UNION ALL SELECT log_id, pos, level, code, 'fixed' FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE b.key = c.key AND b.nth = c.nth))"""


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostics of even logs stand for the current ones, those of odd logs for the baseline."""
    key = F.unhex(F.sha2(F.concat_ws("\0", "level", "code", normalized_span(F.col("message"))), 256))
    # both passes over the bags read what is written here, instead of hashing all messages twice
    d = settled(diagnostics(spark, sf_dir).select("log_id", "pos", "level", "code", key.alias("key")), "diagnostics")
    return bag_sides(d, F.col("log_id") % 2 == 0, ["key"], ["log_id", "pos"], F.expr("log_id div 64")).drop("key")


@query(f"WITH {_DELTA} SELECT * FROM delta")
def diag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics that are new, were there before, or are gone, as bags: positions don't count."""
    return _delta(spark, sf_dir)


@query(f"""WITH {_DELTA} SELECT side, level, count(*) AS n, count(*) FILTER (WHERE code = '' AND level IN ('error', 'warning')) > 0 AS approximate FROM delta GROUP BY 1, 2""")
def diag_delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta's sizes, and whether diagnostics without code make it approximate."""
    vague = (F.col("code") == "") & F.col("level").isin("error", "warning")
    return _delta(spark, sf_dir).groupBy("side", "level").agg(F.count("*").alias("n"), (F.count_if(vague) > 0).alias("approximate"))


@query(f"WITH {PATHS}, p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(host) ELSE host END AS path FROM paths), f AS (SELECT *, first_value(path) OVER (PARTITION BY lower(path) ORDER BY page_id) AS first FROM p) SELECT page_id, path, first FROM f WHERE path <> first")
def case_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that differ from an earlier one in case only."""
    p = paths(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 2 == 0, F.upper("host")).otherwise(F.col("host")).alias("path"))
    firsts = p.groupBy(F.lower("path").alias("low")).agg(F.min_by("path", "page_id").alias("first"))
    return p.join(firsts, F.lower("path") == F.col("low")).filter("path <> first").select("page_id", "path", "first")


def is_digest(image: Column) -> Column:
    """Whether an image is named by its content, and not by a tag that may move."""
    return image.rlike("@sha256:[0-9a-f]{64}$")


def fingerprints(rows: DataFrame) -> DataFrame:
    """id, error, fingerprint and granted: one hash over all fields (manifest, image, toolchain, profile), and that with grants folded in.

    Fields are prefixed with their lengths, so no two lists of fields read alike. Without a manifest, or with an image that is no digest, there is no
    fingerprint, and error tells why. Grants count sorted and once each; none change nothing.
    """
    error = F.when(F.coalesce("manifest", F.lit("")) == "", "missing_manifest").when(~F.coalesce(is_digest(F.col("image")), F.lit(False)), "image_not_digest").otherwise("")
    plain = F.sha2(length_prefixed(F.col("manifest"), F.col("image"), F.col("toolchain"), F.sha2("profile", 256)), 256)
    grants = F.array_sort(F.array_distinct("grants"))
    # a grant is prefixed with its length too
    folded = F.sha2(F.concat(plain, F.array_join(F.transform(grants, lambda g: F.concat(F.octet_length(g).cast("string"), F.lit(":"), g)), "")), 256)
    out = rows.select("id", error.alias("error"), plain.alias("fingerprint"), F.when(F.size(grants) > 0, folded).otherwise(plain).alias("granted"))
    return out.select("id", "error", *[F.when(F.col("error") == "", F.col(c)).otherwise("").alias(c) for c in ("fingerprint", "granted")])


_PRE = "strlen({0}) || ':' || {0}"


@query(f"""WITH {TASKS}, f AS (SELECT id, k, CASE WHEN k % 11 = 0 THEN '' ELSE sha256(worktree) END AS manifest, CASE WHEN k % 7 = 0 THEN 'img:' || k ELSE 'img@sha256:' || sha256(event_type) END AS image, event_type AS toolchain, sha256(project::VARCHAR) AS profile FROM tasks),
 p AS (SELECT *, CASE WHEN manifest = '' THEN 'missing_manifest' WHEN k % 7 = 0 THEN 'image_not_digest' ELSE '' END AS error, sha256({_PRE.format("manifest")} || {_PRE.format("image")} || {_PRE.format("toolchain")} || {_PRE.format("profile")}) AS plain FROM f)
 SELECT id, error, CASE WHEN error = '' THEN plain ELSE '' END AS fingerprint, CASE WHEN error <> '' THEN '' WHEN k % 4 = 0 THEN plain ELSE sha256(plain || array_to_string(list_transform(list_sort(list_distinct(['g' || (k % 5), 'g' || (k % 3)])), lambda g: strlen(g) || ':' || g), '')) END AS granted FROM p""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of tasks, plain and with their grants, or why a task has none."""
    k = F.col("k")
    grants = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("g"), k % 5), F.concat(F.lit("g"), k % 3)))
    rows = tasks(spark, sf_dir).select(
        "id", F.when(k % 11 == 0, "").otherwise(F.sha2("worktree", 256)).alias("manifest"), F.when(k % 7 == 0, F.concat(F.lit("img:"), k.cast("string"))).otherwise(F.concat(F.lit("img@sha256:"), F.sha2("event_type", 256))).alias("image"),
        F.col("event_type").alias("toolchain"), F.col("project").cast("string").alias("profile"), grants.alias("grants"),
    )
    return fingerprints(rows)


@query(f"""WITH {TASKS}, a AS (SELECT project, list_sort(list(DISTINCT event_type)) AS has FROM tasks WHERE id % 3 = 0 GROUP BY 1) SELECT project, coalesce(list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(has, x))[1], '') AS first_missing FROM a""")
def capability_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first capability that a worker lacks of those required."""
    has = tasks(spark, sf_dir).filter("id % 3 = 0").groupBy("project").agg(F.collect_set("event_type").alias("has"))
    need = F.array(*map(F.lit, ("click", "purchase", "view")))
    return has.select("project", F.coalesce(F.get(F.array_except(need, "has"), F.lit(0)), F.lit("")).alias("first_missing"))


@query(f"""WITH {TASKS}, a AS (SELECT project, coalesce(list_sort(list(DISTINCT k) FILTER (WHERE status = 'running')), []) AS r, coalesce(list_sort(list(DISTINCT k) FILTER (WHERE status = 'queued')), []) AS q FROM tasks GROUP BY 1) SELECT project, array_to_string(list_sort(list_intersect(r, q)), ',') AS assigned FROM a""")
def assigned_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned work that the worker reports as under way."""
    per = tasks(spark, sf_dir).groupBy("project").agg(F.collect_set(F.when(F.col("status") == "running", F.col("k"))).alias("r"), F.collect_set(F.when(F.col("status") == "queued", F.col("k"))).alias("q"))
    return per.select("project", F.array_join(F.transform(F.array_sort(F.array_intersect("r", "q")), lambda x: x.cast("string")), ",").alias("assigned"))


@query(f"""WITH {TASKS}, f AS (SELECT project, event_type, min((at_us, id)) AS first FROM tasks GROUP BY 1, 2) SELECT project, string_agg(event_type, ',' ORDER BY first) AS types FROM f GROUP BY 1""")
def ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type once, in the order in which they first came."""
    first = tasks(spark, sf_dir).groupBy("project", "event_type").agg(F.min(F.struct("at_us", "id")).alias("first"))
    inorder = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("project").agg(F.array_join(inorder, ",").alias("types"))


@query("SELECT o_orderkey AS path, o_totalprice AS size FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def index_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows whose files are still live."""
    live = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size")).join(live, "path", "left_semi")


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ' || p_brand || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part")
def array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma lists to arrays and back, without blanks and empty entries."""
    items = F.filter(F.transform(F.split(F.concat("p_name", F.lit(" , "), "p_brand", F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(items, "|").alias("items"))


@query(f"""WITH {TASKS} SELECT id, left(sha256('p' || project), 16) AS project_id, left(sha256(project || chr(0) || worktree), 16) AS worktree_id, left(sha256(project || chr(0) || worktree || chr(0) || event_type), 16) AS supersede_key FROM tasks""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that depend on what they name alone."""
    h = lambda *c: F.left(F.sha2(F.concat_ws("\0", *c), 256), F.lit(16))
    return tasks(spark, sf_dir).select("id", F.left(F.sha2(F.concat(F.lit("p"), F.col("project")), 256), F.lit(16)).alias("project_id"), h("project", "worktree").alias("worktree_id"), h("project", "worktree", "event_type").alias("supersede_key"))


@query(f"""WITH {TASKS}, f AS (SELECT project, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS features, string_agg(DISTINCT worktree, ',' ORDER BY worktree) AS egress FROM tasks GROUP BY 1) SELECT project, 'features=' || features || chr(10) || 'egress=' || egress AS canonical FROM f""")
def canonical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile as one text with its sets sorted."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = tasks(spark, sf_dir).groupBy("project").agg(joined("event_type").alias("f"), joined("worktree").alias("e"))
    return per.select("project", F.concat(F.lit("features="), "f", F.lit("\negress="), "e").alias("canonical"))


@query(f"""WITH {TASKS} SELECT id, CASE WHEN k * 4097 < 1024 THEN printf('%d B', k * 4097) WHEN k * 4097 < 1048576 THEN printf('%.1f KiB', k * 4097 / 1024.0::DOUBLE) ELSE printf('%.1f MiB', k * 4097 / 1048576.0::DOUBLE) END AS size,
 CASE WHEN build_ms < 1000 THEN build_ms || 'ms' WHEN build_ms < 60000 THEN (build_ms // 1000) || 's' ELSE (build_ms // 60000) || 'm' || (build_ms // 1000 % 60) || 's' END AS duration, left(worktree || project, 8) AS short FROM tasks""")
def humanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, durations and ids for people."""
    ms = F.col("build_ms")
    duration = F.when(ms < 1000, F.concat(ms, F.lit("ms"))).when(ms < 60_000, F.concat(F.expr("build_ms div 1000"), F.lit("s"))).otherwise(F.concat(F.expr("build_ms div 60000"), F.lit("m"), F.expr("build_ms div 1000 % 60"), F.lit("s")))
    return tasks(spark, sf_dir).select("id", human_bytes(F.col("k") * 4097).alias("size"), duration.alias("duration"), F.left(F.concat("worktree", F.col("project").cast("string")), F.lit(8)).alias("short"))


def ago(ms: Column, now: Column) -> Column:
    """How long ago a time (milliseconds) was, in the largest whole unit; 0 is never, and what lies ahead is now."""
    d = F.greatest(now - ms, F.lit(0))
    unit = lambda size, name: F.concat(F.floor(d / size).cast("string"), F.lit(name))
    return F.when(ms == 0, "never").when(d < 5_000, "now").when(d < 60_000, unit(1000, "s ago")).when(d < 3_600_000, unit(60_000, "m ago")).when(d < 86_400_000, unit(3_600_000, "h ago")).otherwise(unit(86_400_000, "d ago"))


def percent(share: Column) -> Column:
    """A share as whole percents, halves rounded up."""
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def whole_duration(seconds: Column) -> Column:
    """Seconds in the largest unit that holds them whole."""
    out = F.concat(seconds.cast("string"), F.lit(" s"))
    for size, name in ((60, " min"), (3600, " h"), (86_400, " d")):
        out = F.when(seconds % size == 0, F.concat((seconds / size).cast("long").cast("string"), F.lit(name))).otherwise(out)
    return out


def short_id(name: Column, keep: int = 10) -> Column:
    """An id cut for people: the end of it, behind its kind if it begins with a short one; ids that are hardly longer stay as they are."""
    dash = F.instr(name, "-")
    head = F.when((dash > 1) & (dash <= 9), F.substring(name, F.lit(1), dash)).otherwise("")
    tail = F.when(head == "", keep).otherwise(F.greatest(keep - F.length(head), F.lit(6)))
    cut = F.concat(head, F.lit("…"), F.right(name, tail))
    return F.when(F.length(name) <= keep + 3, name).when((head != "") & (F.length(name) - F.length(head) <= tail), name).otherwise(cut)


@query(f"""WITH {TASKS}, a AS (SELECT id, k, CASE WHEN id % 9 = 0 THEN 0 ELSE at_us // 1000 + CASE WHEN id % 9 = 1 THEN 10000000000 ELSE 0 END END AS ms, us // 1000 AS now FROM tasks, now), d AS (SELECT *, greatest(now - ms, 0) AS d,
  CASE id % 4 WHEN 0 THEN 'worker-' || lpad(id::VARCHAR, 12, '0') WHEN 1 THEN repeat('x', 10) || id WHEN 2 THEN 't-1' ELSE 'averylongkind-' || id END AS name FROM a)
 SELECT id, CASE WHEN ms = 0 THEN 'never' WHEN d < 5000 THEN 'now' WHEN d < 60000 THEN (d // 1000) || 's ago' WHEN d < 3600000 THEN (d // 60000) || 'm ago' WHEN d < 86400000 THEN (d // 3600000) || 'h ago' ELSE (d // 86400000) || 'd ago' END AS age, CAST(floor(k / 64.0::DOUBLE * 100 + 0.5) AS BIGINT) || '%' AS share,
 CASE WHEN k * 900 % 86400 = 0 THEN (k * 900 // 86400) || ' d' WHEN k * 900 % 3600 = 0 THEN (k * 900 // 3600) || ' h' ELSE (k * 15) || ' min' END AS every,
 CASE id % 4 WHEN 0 THEN 'worker-…' || right(name, 6) WHEN 1 THEN CASE WHEN length(name) <= 13 THEN name ELSE '…' || right(name, 10) END WHEN 2 THEN name ELSE '…' || right(name, 10) END AS short FROM d""")
def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages, shares, intervals and ids as a page shows them."""
    t = tasks(spark, sf_dir)
    n = F.col("id")
    ms = F.when(n % 9 == 0, 0).otherwise(F.expr("at_us div 1000") + F.when(n % 9 == 1, F.lit(10_000_000_000)).otherwise(F.lit(0)))
    name = F.when(n % 4 == 0, F.concat(F.lit("worker-"), F.lpad(n.cast("string"), 12, "0"))).when(n % 4 == 1, F.concat(F.repeat(F.lit("x"), 10), n.cast("string"))).when(n % 4 == 2, "t-1").otherwise(F.concat(F.lit("averylongkind-"), n.cast("string")))
    now = F.floor(as_of(t) / 1000)
    return t.select("id", ago(ms, now).alias("age"), percent(F.col("k") / 64.0).alias("share"), whole_duration(F.col("k") * 900).alias("every"), short_id(name).alias("short"))


@query(f"""WITH {TASKS} SELECT id, CASE WHEN k % 3 = 0 THEN 'workspace' WHEN k % 3 = 1 THEN 'package ' || worktree ELSE 'packages ' || worktree || ', p' || project END AS label, CASE WHEN k % 3 = 0 THEN '--workspace' WHEN k % 3 = 1 THEN '-p ' || worktree ELSE '-p ' || worktree || ' -p p' || project END AS flags FROM tasks""")
def scope_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scope's label and the flags that select it."""
    one, two = F.col("k") % 3 == 0, F.col("k") % 3 == 1
    p = F.concat(F.lit("p"), F.col("project"))
    label = F.when(one, "workspace").when(two, F.concat(F.lit("package "), "worktree")).otherwise(F.concat(F.lit("packages "), "worktree", F.lit(", "), p))
    return tasks(spark, sf_dir).select("id", label.alias("label"), F.when(one, "--workspace").when(two, F.concat(F.lit("-p "), "worktree")).otherwise(F.concat(F.lit("-p "), "worktree", F.lit(" -p "), p)).alias("flags"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, true AS equal FROM documents")
def log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs come back from compressed storage in the shared folder as they were, bytes that are no UTF-8 as replacement characters.

    Each log is stored with three bytes more that no text has; they come back as one replacement character each.
    """
    path = shared_path(spark, "logs")
    broken = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("FFFEFD")))
    load(spark, sf_dir, "documents").select("doc_id", broken.alias("log")).write.option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path).withColumn("read", lossy_text(F.col("log")))
    text = F.expr("substr(read, 1, length(read) - 3)")
    return back.select("doc_id", F.sha2(text, 256).alias("hash"), (F.expr("right(read, 3)") == "\ufffd" * 3).alias("equal"))


def lossy_text(data: Column) -> Column:
    """Bytes as text, with a replacement character for each byte that isn't part of UTF-8."""
    return F.make_valid_utf8(data.cast("string"))
