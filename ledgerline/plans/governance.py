"""Configuration, closure of dependencies, sources of truth and reclaim reports."""

from __future__ import annotations

import json
import tomllib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.closure import settled_closure
from ..sources.telemetry import load, tasks
from .base import TASKS, query


@query(f"""WITH {TASKS}, l AS (SELECT project, id % 4 AS layer, arg_max(CASE WHEN k % 3 = 0 THEN NULL ELSE event_type END, (at_us, id)) AS name, arg_max(CASE WHEN k % 2 = 0 THEN NULL ELSE k END, (at_us, id)) AS n FROM tasks GROUP BY 1, 2)
 SELECT project, arg_min(name, layer) FILTER (WHERE name IS NOT NULL) AS name, arg_min(n, layer) FILTER (WHERE n IS NOT NULL) AS n, max(n) FILTER (WHERE layer = 0) AS disclosed FROM l GROUP BY 1""")
def profile_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of configuration laid over each other, the first that says something winning; what is to be disclosed isn't inherited."""
    t = tasks(spark, sf_dir).withColumn("layer", F.col("id") % 4)
    at = F.struct("at_us", "id")
    said = lambda c, given: F.max_by(F.when(given, F.col(c)), F.when(given, at))
    layers = t.groupBy("project", "layer").agg(said("event_type", F.col("k") % 3 != 0).alias("name"), said("k", F.col("k") % 2 != 0).alias("n"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("layer")))
    return layers.groupBy("project").agg(first("name").alias("name"), first("n").alias("n"), F.max(F.when(F.col("layer") == 0, F.col("n"))).alias("disclosed"))


_EDGES = """edges AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation WHERE n_nationkey % 4 = 1 UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_nationkey % 3 = 0
 UNION SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey BETWEEN 13 AND 22)"""


@query(f"""WITH RECURSIVE {_EDGES}, c(root, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT root, dst, depth + 1 FROM c JOIN edges ON src = node WHERE depth < 5),
 r AS (SELECT root, node, min(depth) AS depth FROM c GROUP BY 1, 2), w AS (SELECT root, bool_or(node % 11 = 8 OR depth > 4) AS bad FROM r GROUP BY 1)
 SELECT r.root, node, depth, true AS complete FROM r JOIN w ON r.root = w.root WHERE NOT bad UNION ALL SELECT root, NULL, NULL, false FROM w WHERE bad""")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that each root reaches in four steps, with the fewest steps.

    A root from which a node is reached that failed to load, or from which more than four steps lead, is incomplete and has no nodes at all.
    """
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    ways = [("k % 4 = 1", (F.col("k") * 7 + 3) % 25), ("k % 3 = 0", (F.col("k") * 3 + 1) % 25), ("k BETWEEN 13 AND 22", F.col("k") + 1)]
    edges = reduce(DataFrame.unionAll, [n.filter(where).select(F.col("k").alias("src"), to.alias("dst")) for where, to in ways]).distinct()
    return settled_closure(n.select(F.col("k").alias("root")), edges, 4, F.col("node") % 11 == 8)


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'busy' WHEN o_totalprice < 50000 THEN 'small' WHEN o_orderdate > (SELECT max(o_orderdate) - INTERVAL 180 DAY FROM orders) THEN 'recent' ELSE 'reclaim' END AS decision, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS bytes FROM orders GROUP BY 1""")
def reclaim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided about each volume, by decision."""
    o = load(spark, sf_dir, "orders")
    recent = F.col("o_orderdate") > o.agg(F.max("o_orderdate").alias("last")).scalar() - F.expr("INTERVAL 180 DAY")
    decision = F.when(F.col("o_orderstatus") == "P", "busy").when(F.col("o_totalprice") < 50_000, "small").when(recent, "recent").otherwise("reclaim")
    return o.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes"))


@query("""WITH bundles AS (SELECT DISTINCT l_orderkey AS base FROM lineitem), mirrors AS (SELECT p_partkey AS repo, p_size > 10 AS public FROM part)
 SELECT event_id AS id, CASE WHEN o_orderstatus = 'F' THEN 'present' WHEN b.base IS NOT NULL THEN 'bundle' WHEN public THEN 'fetch' ELSE 'unavailable' END AS source
 FROM events LEFT JOIN orders ON o_orderkey = event_id LEFT JOIN bundles b ON b.base = event_id + 1 LEFT JOIN mirrors ON repo = user_id""")
def baseline_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each task's baseline comes from: the mirror that has it, a bundle, a fetch from a public repository, or nowhere.

    What is at hand stands in other tables: commits in a mirror are orders that are done, bundles are orders with line items, repositories are parts.
    """
    asked = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("commit"), (F.col("event_id") + 1).alias("base"), F.col("user_id").alias("repo"))
    present = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("commit"), F.lit("present").alias("present"))
    bundles = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("base")).distinct().withColumn("bundle", F.lit("bundle"))
    public = load(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("repo"), F.lit("fetch").alias("fetch"))
    found = asked.join(present, "commit", "left").join(bundles, "base", "left").join(public, "repo", "left")
    return found.select("id", F.coalesce("present", "bundle", "fetch", F.lit("unavailable")).alias("source"))


#: Settings that are known, with their values where a configuration says nothing of them or nothing that can be used.
KNOBS = {"offline_hours": 24, "max_parallel": 10, "min_disk_gb": 20}


@F.pandas_udf(StringType())
def toml_to_json(text: pd.Series) -> pd.Series:
    """A TOML document as JSON, null if it is null or can't be parsed; dates become texts."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(tomllib.loads(t), default=str)
        except tomllib.TOMLDecodeError:
            return None

    return text.map(one)


def settings(configs: DataFrame) -> DataFrame:
    """id, unknown (keys that nobody knows, sorted, joined by commas) and a column for each of KNOBS out of each configuration (id, conf: TOML).

    A setting of another type than a whole number from 0 up counts as not given, and so does everything in a document that can't be parsed.
    """
    parsed = configs.select("id", toml_to_json("conf").alias("doc"))
    keys = F.coalesce(F.json_object_keys("doc"), F.array().cast("array<string>"))
    value = lambda k, d: F.coalesce(F.when(F.get_json_object("doc", f"$.{k}").rlike("^[0-9]+$"), F.get_json_object("doc", f"$.{k}").try_cast("long")), F.lit(d))
    return parsed.select("id", F.array_join(F.array_sort(F.array_except(keys, F.array(*map(F.lit, KNOBS)))), ",").alias("unknown"), *[value(k, d).alias(k) for k, d in KNOBS.items()])


@query("""WITH c AS (SELECT event_id AS id, event_id % 5 AS way, user_id AS u FROM events)
 SELECT id, CASE way WHEN 1 THEN 'extra,old' WHEN 3 THEN 'mirror' ELSE '' END AS unknown, CASE WHEN way IN (0, 1) THEN u ELSE 24 END AS offline_hours, CASE WHEN way IN (1, 3) THEN u + 1 ELSE 10 END AS max_parallel, 20 AS min_disk_gb FROM c""")
def config_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings out of configurations in TOML, and the keys in them that nobody knows."""
    n, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    conf = (
        F.when(n == 0, F.concat(F.lit("# own\noffline_hours = "), u, F.lit("\nmax_parallel = 'many'\n")))
        .when(n == 1, F.concat(F.lit("offline_hours = "), u, F.lit("\nextra = [1, 2]\nmax_parallel = "), (F.col("user_id") + 1).cast("string"), F.lit("\n[old]\nmin_disk_gb = 5\n")))
        .when(n == 2, "offline_hours = = 3").when(n == 3, F.concat(F.lit("max_parallel = "), (F.col("user_id") + 1).cast("string"), F.lit("\nmin_disk_gb = -4\n[mirror]\nurl = 'x'\nat = 2024-01-01\n")))
    )
    return settings(load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), conf.alias("conf")))


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS fields FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def parse_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines by a schema that tolerates what it doesn't know."""
    parsed = F.from_json("props", "k BIGINT", {"mode": "PERMISSIVE"})
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), parsed["k"].alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("fields")).filter("k is not null")


#: What of a workspace's metadata is read.
METADATA = "workspace_root STRING, packages ARRAY<STRUCT<name: STRING, dependencies: ARRAY<STRUCT<name: STRING, path: STRING>>>>, patch MAP<STRING, MAP<STRING, STRING>>, replace MAP<STRING, STRING>"


def path_dependencies(documents: DataFrame) -> DataFrame:
    """id, package, dependency and path for the path dependencies of each metadata document (id, doc), and for what its patches and replacements point to.

    A patch or replacement of a dependency takes the place of its path, a patch before a replacement; those of other names are
    dependencies of the workspace itself, as package ''. A document that can't be parsed raises an error. Fields that nobody knows are left out.
    """
    doc = documents.select("id", F.from_json("doc", METADATA, {"mode": "FAILFAST"}).alias("d")).select("id", "d.*")
    empty = F.create_map().cast("map<string,string>")
    over = F.aggregate(F.map_values(F.coalesce("patch", F.create_map().cast("map<string,map<string,string>>"))), F.coalesce("replace", empty), lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.map_contains_key(m, k)), m))
    doc = doc.withColumn("over", over)
    each = doc.select("id", "over", F.explode("packages").alias("p")).select("id", "over", F.col("p.name").alias("package"), F.explode("p.dependencies").alias("dep"))
    own = each.select("id", "package", F.col("dep.name").alias("dependency"), F.coalesce(F.try_element_at("over", F.col("dep.name")), F.col("dep.path")).alias("path")).filter("path IS NOT NULL")
    used = F.flatten(F.transform("packages", lambda p: F.transform(p["dependencies"], lambda d: d["name"])))
    rest = doc.select("id", F.explode(F.map_filter("over", lambda k, _: ~F.array_contains(used, k))).alias("dependency", "path"))
    return own.unionByName(rest.select("id", F.lit("").alias("package"), "dependency", "path"))


@query("""WITH d AS (SELECT p_partkey AS id, p_size AS n, 'p' || p_size AS name FROM part), deps AS (
 SELECT id, name AS package, 'util' AS dependency, CASE WHEN n % 4 = 0 THEN '/patched/util' ELSE '/w/' || id || '/util' END AS path FROM d
 UNION ALL SELECT id, name, 'serde', CASE n % 4 WHEN 1 THEN '/patched/serde' WHEN 2 THEN '/replaced/serde' END FROM d
 UNION ALL SELECT id, 'util', 'core', '/x/core' FROM d UNION ALL SELECT id, '', 'extra', '/patched/extra' FROM d WHERE n % 4 = 3)
 SELECT * FROM deps WHERE path IS NOT NULL""")
def json_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path dependencies of each package of each metadata document, with what patches and replacements change; the documents are made of parts."""
    n = F.col("p_size") % 4
    doc = F.concat(
        F.lit('{"workspace_root": "/w", "unknown": 1, "packages": [{"name": "p'), F.col("p_size"), F.lit('", "dependencies": [{"name": "util", "path": "/w/'), F.col("p_partkey"),
        F.lit('/util"}, {"name": "serde", "path": null}]}, {"name": "util", "dependencies": [{"name": "core", "path": "/x/core", "kind": "dev"}]}]'),
        F.when(n == 0, ', "patch": {"crates-io": {"util": "/patched/util"}}').when(n == 1, ', "patch": {"crates-io": {"serde": "/patched/serde"}}').when(n == 2, ', "replace": {"serde": "/replaced/serde"}')
        .otherwise(', "patch": {"https://git": {"extra": "/patched/extra"}}'), F.lit("}"),
    )
    return path_dependencies(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), doc.alias("doc")))


@query("""SELECT s_suppkey AS worker, CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE least((s_suppkey % 9 + s_suppkey % 100 / 100.0) / (1 + s_suppkey % 8), 1.0) END AS load, CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE s_suppkey * 7919 % 400000000 // 1048576 END AS free_gb FROM supplier""")
def os_metric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load per core, from 0 to 1, and free disk out of what each worker's system prints; a worker that prints nothing has neither."""
    k, silent = F.col("s_suppkey"), F.col("s_suppkey") % 11 == 0
    loadavg = F.concat((k % 9).cast("string"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" 0.40 0.33 1/123 4567"))
    df = F.concat(F.lit("Filesystem 1024-blocks Used Available Capacity Mounted on\n/dev/sda1 400000000 40000 "), (k * 7919 % 400_000_000).cast("string"), F.lit(" 40% /"))
    texts = load(spark, sf_dir, "supplier").select(k.alias("worker"), F.when(silent, "").otherwise(loadavg).alias("loadavg"), F.when(silent, "").otherwise(df).alias("df"), (1 + k % 8).alias("cores"))
    row = F.split(F.element_at(F.split("df", "\n"), -1), r"\s+")
    free = F.when(F.size(row) >= 6, F.try_element_at(row, F.lit(-3)).try_cast("long")) / (1 << 20)
    load1 = F.coalesce(F.get(F.split("loadavg", " "), F.lit(0)).try_cast("double"), F.lit(0.0)) / F.col("cores")
    return texts.select("worker", F.least(F.greatest(load1, F.lit(0.0)), F.lit(1.0)).alias("load"), F.coalesce(F.floor(free).cast("long"), F.lit(0)).alias("free_gb"))


@query(f"""WITH {TASKS} SELECT id, CASE WHEN result_kind = 'success' THEN 'none' WHEN result_kind = 'compile_error' THEN 'code' WHEN result_kind = 'env_error' THEN 'project_config' ELSE 'infra' END AS attribution, result_kind IN ('success', 'compile_error') AS cacheable, result_kind = 'infra_error' AS retryable FROM tasks""")
def verdict_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a result is put down to, whether it may be cached, and whether to try again."""
    who = F.when(F.col("result_kind") == "success", "none").when(F.col("result_kind") == "compile_error", "code").when(F.col("result_kind") == "env_error", "project_config").otherwise("infra")
    return tasks(spark, sf_dir).select("id", who.alias("attribution"), F.col("result_kind").isin("success", "compile_error").alias("cacheable"), (F.col("result_kind") == "infra_error").alias("retryable"))


#: What of a manifest or configuration, as JSON, is read of patches and replacements.
OVERRIDES = "patch MAP<STRING, MAP<STRING, STRING>>, replace MAP<STRING, STRING>"


def override_paths(files: DataFrame) -> DataFrame:
    """id, dependency, path and readable of what patches and replacements of each file (id, kind, root, text: TOML) point to by path, each once.

    Manifests may patch and replace, configurations only patch. Relative paths are taken from the file's root. Entries without a path,
    say of a git branch, point nowhere. A file that can't be parsed gives one row with nothing but readable = false.
    """
    parsed = files.withColumn("doc", toml_to_json("text"))
    d = F.from_json("doc", OVERRIDES)
    spec = lambda m: F.coalesce(m, F.create_map().cast("map<string,string>"))
    patches = F.flatten(F.transform(F.map_values(F.coalesce(d["patch"], F.create_map().cast("map<string,map<string,string>>"))), F.map_entries))
    both = F.concat(patches, F.when(F.col("kind") == "manifest", F.map_entries(spec(d["replace"]))).otherwise(F.array().cast("array<struct<key:string,value:string>>")))
    each = parsed.filter("doc IS NOT NULL").select("id", "root", F.explode(both).alias("e")).select("id", "root", F.col("e.key").alias("dependency"), F.get_json_object("e.value", "$.path").alias("p"))
    path = F.when(F.startswith("p", F.lit("/")), F.col("p")).otherwise(F.concat_ws("/", "root", "p"))
    found = each.filter("p IS NOT NULL").select("id", "dependency", path.alias("path"), F.lit(True).alias("readable")).distinct()
    none = F.lit(None).cast("string")
    return found.unionByName(parsed.filter("doc IS NULL AND text IS NOT NULL").select("id", none.alias("dependency"), none.alias("path"), F.lit(False).alias("readable")))


@query("""WITH m AS (SELECT p_partkey AS id, p_size % 5 AS way, '/w/' || p_size AS root FROM part)
 SELECT id, 'util' AS dependency, '/abs/util' AS path, true AS readable FROM m WHERE way IN (0, 3) UNION ALL SELECT id, 'core', root || '/../core', true FROM m WHERE way IN (0, 3)
 UNION ALL SELECT id, 'old:1.0', root || '/old', true FROM m WHERE way = 0 UNION ALL SELECT id, NULL, NULL, false FROM m WHERE way = 2""")
def manifest_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local paths that patches and replacements in manifests and configurations point to; the files are made of parts."""
    n, root = F.col("p_size") % 5, F.concat(F.lit("/w/"), "p_size")
    patches = '[patch.crates-io]\nutil = { path = "/abs/util" }\nserde = { git = "https://x" }\n[patch."https://git"]\ncore = { path = "../core", version = "1" }\n'
    text = F.when(n.isin(0, 3), patches + '[replace]\n"old:1.0" = { path = "old" }\n').when(n == 1, '[package]\nname = "a"\n').when(n == 2, "[patch").otherwise("")
    return override_paths(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(n == 3, "config").otherwise("manifest").alias("kind"), root.alias("root"), text.alias("text")))


_RAW = "['amd64', ' ARM64 ', 'x86_64-unknown-linux-gnu', 'aarch64', '', 'riscv64', 'armv7l', 'bad arch!', 'sparc_v9'][1 + p_size % 9]"
_ARCH = "CASE WHEN a IN ('amd64', 'x86_64', 'x64') THEN 'x86_64' WHEN a IN ('arm64', 'aarch64') THEN 'aarch64' WHEN a IN ('arm', 'armv7', 'armv7l') THEN 'arm' WHEN regexp_full_match(a, '[a-z0-9_]+') THEN a END"
_RAWS = ("amd64", " ARM64 ", "x86_64-unknown-linux-gnu", "aarch64", "", "riscv64", "armv7l", "bad arch!", "sparc_v9")


@query(f"WITH n AS (SELECT p_partkey, lower(trim(split_part(trim({_RAW}), '-', 1))) AS a FROM part) SELECT p_partkey, {_ARCH} AS arch FROM n")
def arch_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Architectures by one name each, from aliases and target triples; plausible ones that nobody knows keep their name, others are null."""
    raw = F.element_at(F.array(*map(F.lit, _RAWS)), F.col("p_size") % 9 + 1)
    return load(spark, sf_dir, "part").select("p_partkey", arch_of_target(raw).alias("arch"))


def arch_name(raw: Column) -> Column:
    """The one name of an architecture, null for what can't be one."""
    a = F.lower(F.trim(raw))
    return F.when(a.isin("amd64", "x86_64", "x64"), "x86_64").when(a.isin("arm64", "aarch64"), "aarch64").when(a.isin("arm", "armv7", "armv7l"), "arm").when(a.rlike("^[a-z0-9_]+$"), a)


def arch_of_target(triple: Column) -> Column:
    return arch_name(F.split_part(F.trim(triple), F.lit("-"), F.lit(1)))


def arch_list(field: Column) -> Column:
    """The architectures of a field with several, parted by commas, semicolons or white space, sorted, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(field, "[,;\\s]+"), arch_name), lambda a: a.isNotNull())))


def arch_matches(worker: Column, image: Column) -> Column:
    """Whether a worker may run an image: any worker where the image names no architecture, else one of a named one."""
    return (F.size(arch_list(image)) == 0) | F.coalesce(F.array_contains(arch_list(image), arch_name(worker)), F.lit(False))


def arch_demand(image: Column, target: Column) -> Column:
    """What a task asks for: the image's architecture if it has just one, else that of its target, else nothing."""
    own = arch_list(image)
    return F.coalesce(F.when(F.size(own) == 1, F.get(own, F.lit(0))), arch_of_target(target), F.lit(""))


@query(f"""WITH n AS (SELECT p_partkey, {_RAW} AS worker, ['', 'amd64', 'x86_64, aarch64', 'arm64;riscv64 ', 'x64 amd64', 'bad!'][1 + p_partkey % 6] AS image, ['', 'aarch64-apple-darwin', 'riscv64gc-unknown-none', '??'][1 + p_partkey % 4] AS target FROM part),
 x AS (SELECT p_partkey, worker, target, unnest(regexp_split_to_array(image, '[,;\\s]+')) AS a FROM n), y AS (SELECT p_partkey, list_sort(list(DISTINCT {_ARCH.replace("a IN", "lower(a) IN").replace("(a,", "(lower(a),")}) FILTER (WHERE {_ARCH} IS NOT NULL)) AS arches FROM x GROUP BY 1),
 z AS (SELECT n.p_partkey, coalesce(arches, []) AS arches, (SELECT {_ARCH} FROM (SELECT lower(trim(worker)) AS a)) AS worker, (SELECT {_ARCH} FROM (SELECT lower(split_part(trim(target), '-', 1)) AS a)) AS target FROM n JOIN y USING (p_partkey))
 SELECT p_partkey, len(arches) = 0 OR coalesce(list_contains(arches, worker), false) AS matches, CASE WHEN len(arches) = 1 THEN arches[1] ELSE coalesce(target, '') END AS demand FROM z""")
def arch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a worker may run an image, and what a task of that image and target asks for."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    image = pick(("", "amd64", "x86_64, aarch64", "arm64;riscv64 ", "x64 amd64", "bad!"), F.col("p_partkey") % 6)
    target = pick(("", "aarch64-apple-darwin", "riscv64gc-unknown-none", "??"), F.col("p_partkey") % 4)
    return load(spark, sf_dir, "part").select("p_partkey", arch_matches(pick(_RAWS, F.col("p_size") % 9), image).alias("matches"), arch_demand(image, target).alias("demand"))


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'lib' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 2) END AS name FROM part) SELECT p_partkey, name, CASE WHEN starts_with(name, 'lib') THEN name || '-dev' ELSE 'lib' || name || '-dev' END AS package FROM n""")
def package_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package that convention suggests for a library."""
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("lib"), word)).otherwise(word)
    return load(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("package", F.when(F.col("name").startswith("lib"), F.concat("name", F.lit("-dev"))).otherwise(F.concat(F.lit("lib"), "name", F.lit("-dev"))))
