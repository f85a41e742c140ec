"""Paths, hosts and addresses: safety, exclusion, allow lists, algebra and layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.globs import to_regex
from ..operators.matching import prefixes
from ..sources.telemetry import load, paths
from .base import PATHS, query


@query(f"""WITH {PATHS}, c AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN path WHEN 1 THEN '/' || path WHEN 2 THEN '../' || path WHEN 3 THEN path || '//x' WHEN 4 THEN 'C:/' || path ELSE replace(path, '/', chr(92)) END AS p FROM paths)
 SELECT page_id, p <> '' AND NOT starts_with(p, '/') AND NOT contains(p, chr(92)) AND NOT regexp_matches(p, '^[A-Za-z]:') AND NOT list_has_any(string_split(p, '/'), ['', '.', '..']) AS safe FROM c""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path stays under its root: relative, no empty, . or .. segment, no backslash, no drive."""
    n = F.col("page_id") % 6
    p = F.when(n == 0, F.col("path")).when(n == 1, F.concat(F.lit("/"), "path")).when(n == 2, F.concat(F.lit("../"), "path")).when(n == 3, F.concat("path", F.lit("//x"))).when(n == 4, F.concat(F.lit("C:/"), "path")).otherwise(F.replace("path", F.lit("/"), F.lit("\\")))
    return paths(spark, sf_dir).select("page_id", is_safe(p).alias("safe"))


def is_safe(p: Column) -> Column:
    bad = F.arrays_overlap(F.split(p, "/"), F.array(F.lit(""), F.lit("."), F.lit("..")))
    return (p != "") & ~p.startswith("/") & ~p.contains("\\") & ~p.rlike("^[A-Za-z]:") & ~bad


@query(f"""WITH {PATHS}, m AS (SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN regexp_replace(path, '/[^/]*$', '') WHEN 2 THEN left(path, 2) ELSE path || '/x' END AS mount FROM paths)
 SELECT page_id, mount, mount = '' OR path = mount OR starts_with(path, mount || '/') AS under FROM m""")
def under_mount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path lies under a mount, by whole segments; mounts are nothing, the path's folder, its first two characters, or something below it."""
    n = F.col("page_id") % 4
    mount = F.when(n == 0, "").when(n == 1, F.regexp_replace("path", "/[^/]*$", "")).when(n == 2, F.left("path", F.lit(2))).otherwise(F.concat("path", F.lit("/x")))
    return paths(spark, sf_dir).withColumn("mount", mount).select("page_id", "mount", is_under(F.col("path"), F.col("mount")).alias("under"))


def is_under(path: Column, mount: Column) -> Column:
    return (mount == "") | (path == mount) | F.startswith(path, F.concat(mount, F.lit("/")))


#: Folders that are never taken, as the first segment, and those that a project's adapter never takes, as any segment.
ALWAYS, ADAPTER = (".git", "node_modules", ".direnv", ".venv"), ("target", "fr")
#: Patterns that a project ignores, and those that it takes none the less.
IGNORED, INCLUDED = ["*.tmp", "/gen/", "fr/*", "!fr/8*", "de/**/x", "*7"], ["/gen/*.conf", "/en/**"]


def excluded(path: Column) -> Column:
    """Whether a path is never taken, whatever includes say."""
    parts = F.split(path, "/")
    return F.get(parts, F.lit(0)).isin(*ALWAYS) | F.arrays_overlap(parts, F.array(*map(F.lit, ADAPTER)))


def is_ignored(path: Column, rules: list[str]) -> Column:
    """Whether a list of ignore patterns excludes a path: the last rule that matches a prefix decides for it, the first excluded prefix for the path."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), (n < F.size(parts)).alias("is_dir")))

    def verdict(x: Column) -> Column:
        out = F.lit(False)
        for rule in rules:
            regex, negated, only_dir = to_regex(rule)
            hit = x["path"].rlike(regex) & (x["is_dir"] if only_dir else F.lit(True))
            out = F.when(hit, F.lit(not negated)).otherwise(out)
        return out

    return F.exists(ups, verdict)


def included(path: Column, rules: list[str]) -> Column:
    return path.rlike("|".join(to_regex(r)[0] for r in rules))


def enumerated(listed: DataFrame, found: DataFrame) -> DataFrame:
    """path and why (listed or included) of the files of a project, each once: those that version control lists (`listed`), then those of a
    walk (`found`) that are ignored but included and not listed yet. What is excluded goes, whatever lists or includes it."""
    first = listed.select("path").distinct().filter(~excluded(F.col("path")))
    path = F.col("path")
    second = found.select("path").distinct().filter(is_ignored(path, IGNORED) & included(path, INCLUDED) & ~excluded(path)).join(first, "path", "left_anti")
    return first.withColumn("why", F.lit("listed")).unionByName(second.withColumn("why", F.lit("included")))


def walked(found: DataFrame) -> DataFrame:
    """The files of a project without version control: all that a walk finds but what is ignored or excluded, each once."""
    return found.select("path").distinct().filter(~is_ignored(F.col("path"), IGNORED) & ~excluded(F.col("path")))


# files that version control tracks, that it doesn't track, of its submodules, and that only a walk finds
_FILES = f"""{PATHS}, tracked AS (SELECT path FROM paths WHERE path <> ''), untracked AS (SELECT 'src/' || p_brand || '/' || p_partkey || '.rs' AS path FROM part UNION ALL SELECT 'target/debug/' || p_partkey FROM part WHERE p_size = 1),
 submodules AS (SELECT 'vendor/' || n_name || '/' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'node_modules/' || n_name FROM nation),
 listed AS (SELECT path FROM tracked UNION ALL SELECT path FROM untracked UNION ALL SELECT path FROM submodules),
 walk AS (SELECT path FROM listed UNION ALL SELECT 'gen/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.conf' ELSE '.tmp' END FROM supplier UNION ALL SELECT 'src/x' || s_suppkey || '.tmp' FROM supplier UNION ALL SELECT '.git/' || s_suppkey FROM supplier),
 kept AS (SELECT DISTINCT path, split_part(path, '/', 1) IN ('.git', 'node_modules', '.direnv', '.venv') OR list_has_any(string_split(path, '/'), ['target', 'fr']) AS excluded,
  regexp_matches(path, '(^|/)[^/]*[.]tmp(/|$)') OR starts_with(path, 'gen/') OR regexp_matches(path, '(^|/)[^/]*7(/|$)') OR regexp_matches(path, '^de/([^/]+/)*x(/|$)') OR (regexp_matches(path, '^fr/') AND NOT regexp_matches(path, '^fr/8')) AS ignored,
  regexp_matches(path, '^gen/[^/]*[.]conf$') OR starts_with(path, 'en/') AS included FROM walk)"""


def project_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What version control lists of a project, tracked or not and of submodules, and what a walk over its folder finds."""
    part, text = load(spark, sf_dir, "part"), lambda c: F.col(c).cast("string")
    tracked = paths(spark, sf_dir).filter("path <> ''").select("path")
    untracked = part.select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), text("p_partkey"), F.lit(".rs")).alias("path")).unionAll(part.filter("p_size = 1").select(F.concat(F.lit("target/debug/"), text("p_partkey"))))
    nation = load(spark, sf_dir, "nation")
    homes = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    submodules = homes.select(F.concat(F.lit("vendor/"), "n_name", F.lit("/"), text("c_custkey")).alias("path")).unionAll(nation.select(F.concat(F.lit("node_modules/"), "n_name")))
    listed = tracked.unionAll(untracked).unionAll(submodules)
    n = text("s_suppkey")
    names = [F.concat(F.lit("gen/"), n, F.when(F.col("s_suppkey") % 2 == 0, ".conf").otherwise(".tmp")), F.concat(F.lit("src/x"), n, F.lit(".tmp")), F.concat(F.lit(".git/"), n)]
    more = load(spark, sf_dir, "supplier").select(F.explode(F.array(*names)).alias("path"))
    return listed, listed.unionAll(more)


@query(f"""WITH {_FILES}, first AS (SELECT DISTINCT path FROM listed JOIN kept USING (path) WHERE NOT excluded)
 SELECT path, 'listed' AS why FROM first UNION ALL SELECT path, 'included' FROM kept WHERE ignored AND included AND NOT excluded AND path NOT IN (SELECT path FROM first)""")
def enumerate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked, untracked and submodules' files and those that are included though ignored, each once; exclusion always wins over inclusion."""
    return enumerated(*project_files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT path FROM kept WHERE NOT ignored AND NOT excluded")
def walk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder without version control, by a walk that heeds ignore patterns."""
    return walked(project_files(spark, sf_dir)[1])


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'symlink' WHEN 1 THEN 'directory' WHEN 2 THEN 'missing' ELSE 'file' END AS type, CASE WHEN doc_id % 3 = 0 THEN 33261 ELSE 33188 END AS mode, 'lib/' || source AS target, coalesce(text, '') AS text FROM documents)
 SELECT s.doc_id AS id, type, CASE WHEN type = 'file' THEN sha256(text) ELSE sha256(target) END AS hash, CASE WHEN type = 'file' THEN strlen(text) ELSE strlen(target) END AS size, type = 'file' AND mode & 73 <> 0 AS executable, type = 'file' AND l.doc_id IS NOT NULL AS in_baseline,
  CASE WHEN type = 'symlink' THEN target ELSE '' END AS symlink_target FROM s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE type IN ('file', 'symlink')""")
def stat_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries of what was found on disk; documents stand for files, those with labels for what the baseline has unchanged."""
    n = F.col("doc_id") % 10
    kind = F.when(n == 0, "symlink").when(n == 1, "directory").when(n == 2, "missing").otherwise("file")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kind.alias("type"), F.when(F.col("doc_id") % 3 == 0, 33261).otherwise(33188).alias("mode"), F.concat(F.lit("lib/"), "source").alias("target"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    clean = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct()
    return entries(docs, clean)


def entries(stats: DataFrame, clean: DataFrame) -> DataFrame:
    """id, type, hash, size, executable, in_baseline and symlink_target of files and symbolic links (`stats`: id, type, mode, target, content).

    A link is what it points to: its target is hashed, it is never executable and never in the baseline. Folders and what is gone are
    left out. `clean` has the ids that the baseline holds unchanged.
    """
    link = F.col("type") == "symlink"
    body = F.when(link, F.encode("target", "UTF-8")).otherwise(F.col("content"))
    found = stats.filter(F.col("type").isin("file", "symlink")).join(clean.withColumn("_clean", F.lit(True)), "id", "left")
    return found.select(
        "id", "type", F.sha2(body, 256).alias("hash"), F.octet_length(body).cast("long").alias("size"), (~link & (F.col("mode").bitwiseAND(F.lit(0o111)) != 0)).alias("executable"),
        (~link & F.col("_clean").isNotNull()).alias("in_baseline"), F.when(link, F.col("target")).otherwise("").alias("symlink_target"),
    )


@query(f"""WITH {PATHS}, s AS (SELECT page_id, path, unnest(range(1, len(string_split(path, '/')) + 1)) AS n, string_split(path, '/') AS parts FROM paths),
 u AS (SELECT page_id, array_to_string(parts[1:n], '/') AS up, n < len(parts) AS is_dir FROM s),
 v AS (SELECT page_id, CASE WHEN regexp_matches(up, '^de/([^/]+/)*x$') THEN true WHEN regexp_matches(up, '^fr/8[^/]*$') THEN false WHEN regexp_matches(up, '^fr/[^/]*$') THEN true WHEN up = 'en' AND is_dir THEN true ELSE regexp_matches(up, '(^|/)[^/]*[.]tmp$') END AS hit FROM u)
 SELECT p.page_id, any_value(path) AS path, bool_or(hit) AS ignored FROM paths p JOIN v USING (page_id) GROUP BY 1""")
def ignore_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths a list of ignore patterns excludes; a pattern that excludes a directory excludes what is in it."""
    return paths(spark, sf_dir).select("page_id", "path", is_ignored(F.col("path"), ["*.tmp", "/en/", "fr/*", "!fr/8*", "de/**/x"]).alias("ignored"))


# forms of a pattern by the page's number, with what is wrong with each; hosts of pages are whole names in lower case
_PATTERNS = {
    0: ("  {HOST}  ", ""), 1: ("*.{host}", ""), 2: ("https://{host}", "url"), 3: ("{host}:443", "port"), 4: ("{first}", "single_label"), 5: ("a.*.{host}", "wildcard"), 6: ("10.0.0.1", "address"), 7: ("127.0.0.0x1", "address"),
    8: ("a..{host}", "empty_label"), 9: ("{host}?q", "url"), 10: ("me@{host}", "url"), 11: ("bad_host!.{host}", "characters"), 12: ("*.com", "too_broad"), 13: ("   ", "empty"), 14: ("*.a.*.{host}", "wildcard"), 15: ("{host}#x", "url"), 16: ("{host}.", "empty_label"), 17: ("a b.{host}", "url"), 18: ("x.xn--p1ai", ""),
}


def _pattern_sql(text: str) -> str:
    return "'" + text.replace("{HOST}", "' || upper(host) || '").replace("{host}", "' || host || '").replace("{first}", "' || split_part(host, '.', 1) || '") + "'"


@query(f"""WITH {PATHS} SELECT page_id, CASE page_id % {len(_PATTERNS)} {" ".join(f"WHEN {k} THEN '{why}'" for k, (_, why) in _PATTERNS.items())} END AS error,
 CASE page_id % {len(_PATTERNS)} {" ".join(f"WHEN {k} THEN {_pattern_sql(text.strip().replace('HOST', 'host')) if not why else "''"}" for k, (text, why) in _PATTERNS.items())} END AS host FROM paths""")
def egress_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host patterns trimmed and in lower case, or the first reason to reject one."""
    form, raw = F.col("page_id") % len(_PATTERNS), F.lit(None).cast("string")
    for k, (text, _) in _PATTERNS.items():
        filled = F.lit(text)
        for name, value in (("{HOST}", F.upper("host")), ("{host}", F.col("host")), ("{first}", F.split_part("host", F.lit("."), F.lit(1)))):
            filled = F.replace(filled, F.lit(name), value)
        raw = F.when(form == k, filled).otherwise(raw)
    rows = paths(spark, sf_dir).select("page_id", raw.alias("raw"))
    return rows.select("page_id", egress_error(F.col("raw")).alias("error"), F.lower(F.trim("raw")).alias("host")).withColumn("host", F.when(F.col("error") == "", F.col("host")).otherwise(""))


def egress_error(raw: Column) -> Column:
    """Why a host pattern isn't taken, or an empty text. A pattern is a whole host name, or one behind a leading *. that stands for what is below it.

    An address is no name: the last label must begin with a letter, as readers of addresses take hexadecimal parts too.
    """
    host = F.lower(F.trim(raw))
    wild = host.startswith("*.")
    name = F.when(wild, F.substr(host, F.lit(3))).otherwise(host)
    labels = F.split(name, "[.]")
    url = F.lit(False)
    for mark in ("/", "?", "#", "@", " "):
        url = url | host.contains(mark)
    rules = {
        "empty": host == "", "url": url, "port": host.contains(":"), "wildcard": name.contains("*"), "empty_label": F.exists(labels, lambda x: x == ""), "characters": ~name.rlike("^[a-z0-9.-]*$"),
        "too_broad": wild & (F.size(labels) < 2), "single_label": F.size(labels) < 2, "address": ~F.element_at(labels, -1).rlike("^[a-z]"),
    }
    return F.coalesce(*[F.when(broken, why) for why, broken in rules.items()], F.lit(""))


@query(f"""WITH {PATHS} SELECT page_id, host = 'ththre.example.com' OR host = 'example.org' OR ends_with(host, '.example.org') OR host = 'm.thwhen.example.net' AS allowed,
 CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN contains(path, 'en') ELSE false END AS verb_ok FROM paths""")
def host_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a host is on the list: by name, or under a leading *. with its apex; and whether the verb may be used."""
    allow = F.array(*map(F.lit, ("ththre.example.com", "*.example.org", "m.thwhen.example.net")))
    host = F.regexp_replace(F.lower("host"), ":[0-9]+$", "")
    ok = F.exists(allow, lambda p: F.when(p.startswith("*."), (host == F.substring_index(p, "*.", -1)) | F.endswith(host, F.substr(p, F.lit(2)))).otherwise(host == p))
    n = F.col("page_id") % 4
    return paths(spark, sf_dir).select("page_id", ok.alias("allowed"), F.when(n < 2, True).when(n == 2, F.col("path").contains("en")).otherwise(False).alias("verb_ok"))


@query("SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS verb, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN user_id % 2 = 0 ELSE false END AS allowed FROM events")
def verb_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET and HEAD may pass, POST only to where packs are fetched."""
    e = load(spark, sf_dir, "events")
    verb = F.when(F.col("event_id") % 3 == 0, "GET").when(F.col("event_id") % 3 == 1, "POST").otherwise("PUT")
    path = F.when(F.col("user_id") % 2 == 0, "/repo/git-upload-pack").otherwise("/repo/info")
    return e.select(F.col("event_id").alias("id"), verb.alias("verb"), (verb.isin("GET", "HEAD") | ((verb == "POST") & F.endswith(path, F.lit("/git-upload-pack")))).alias("allowed"))


#: Addresses of version 6 by first group or as a whole, and whether they are internal; those of events take one by their number.
_V6 = {"fc00::1": True, "fdff:1::2": True, "fe80::9": True, "febf::1": True, "fec0::1": False, "2001:db8::1": False, "ff02::1": True, "::1": True, "0:0:0:0:0:0:0:1": True, "::": True,
       "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "0:0:0:0:0:ffff:7f00:1": True, "::ffff:808:808": False, "1::": False, "::2": False}


@query(f"""WITH a AS (SELECT event_id AS id, event_id % 2 = 0 AS v4, [10, 127, 172, 192, 169, 100, 8, 0, 203, 255, 224, 198, 1][1 + event_id % 13] AS o1, CASE event_id % 7 WHEN 0 THEN 255 WHEN 1 THEN 51 WHEN 2 THEN 168 ELSE (event_id * 7) % 256 END AS o2, CASE WHEN event_id % 5 = 0 THEN 255 ELSE event_id % 3 * 50 END AS o3, event_id % 256 AS o4 FROM events),
 b AS (SELECT *, [{", ".join(str(v).lower() for v in _V6.values())}][1 + event_id_ % {len(_V6)}] AS six FROM (SELECT *, id // 2 AS event_id_ FROM a))
 SELECT id, CASE WHEN NOT v4 THEN six ELSE o1 IN (0, 10, 127) OR o1 BETWEEN 224 AND 239 OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168) OR (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 169 AND o2 = 254) OR (o1 = 100 AND o2 BETWEEN 64 AND 127)
  OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113) OR (o1 = 255 AND o2 = 255 AND o3 = 255 AND o4 = 255) END AS internal FROM b""")
def internal_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an address of either version is one that a build has no business reaching."""
    n = F.col("event_id")
    first = F.get(F.array(*map(F.lit, (10, 127, 172, 192, 169, 100, 8, 0, 203, 255, 224, 198, 1))), (n % 13).cast("int"))
    second = F.when(n % 7 == 0, 255).when(n % 7 == 1, 51).when(n % 7 == 2, 168).otherwise(n * 7 % 256)
    v4 = F.concat_ws(".", first, second, F.when(n % 5 == 0, 255).otherwise(n % 3 * 50), n % 256)
    v6 = F.get(F.array(*map(F.lit, _V6)), F.expr(f"cast(event_id div 2 % {len(_V6)} as int)"))
    return load(spark, sf_dir, "events").select(n.alias("id"), is_internal(F.when(n % 2 == 0, v4).otherwise(v6)).alias("internal"))


def is_internal(address: Column) -> Column:
    """For an address as text, of version 4 or 6: loopback, private, link-local, shared, unspecified, multicast, broadcast or for documentation.

    An address of version 6 that holds one of version 4 is judged by that. What can't be read as an address is internal.
    """
    a = F.lower(F.trim(address))
    mapped, hexed = F.regexp_extract(a, r"^[0:]*:ffff:([0-9]+(?:\.[0-9]+){3})$", 1), r"^[0:]*:ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    dotted = F.when(a.rlike(r"^[0-9]+(\.[0-9]+){3}$"), a).otherwise(F.nullif(mapped, F.lit("")))
    octet = lambda k: F.get(F.split(dotted, r"\."), F.lit(k)).try_cast("long")
    part = lambda k: F.when(octet(k) <= 255, octet(k))
    group = lambda k: F.conv(F.nullif(F.regexp_extract(a, hexed, k), F.lit("")), 16, 10).try_cast("long")
    number = F.coalesce(part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3), group(1) * (1 << 16) + group(2))
    blocks = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("100.64.0.0", 10), ("224.0.0.0", 4), ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("255.255.255.255", 32)]
    four = F.lit(False)
    for start, bits in blocks:
        value = sum(int(x) << 8 * k for k, x in enumerate(reversed(start.split("."))))
        four = four | (F.shiftright(number, 32 - bits) == value >> (32 - bits))
    head = F.conv(F.nullif(F.regexp_extract(a, "^([0-9a-f]{1,4}):", 1), F.lit("")), 16, 10).try_cast("int")
    block = lambda bits, start: head.bitwiseAND(F.lit(0xFFFF << (16 - bits) & 0xFFFF)) == start
    six = a.rlike("^[0:]*:0*1$") | a.rlike("^[0:]*$") | F.coalesce(block(8, 0xFF00) | block(7, 0xFC00) | block(10, 0xFE80), F.lit(False))
    return F.when(number.isNotNull(), four).when(a.contains(":") & dotted.isNull(), six).otherwise(F.lit(True))


# forms in which one repository's address may stand
_ADDRESSES = ["git@{}:{}.git", "ssh://git@{}/{}.git", "git+https://{}/{}", "https://{}/{}/", "http://{}/{}.git/", " git+ssh://git@{}/{} ", "{}/{}", "HTTPS://{}/{}"]


def canonical_address(url: Column) -> Column:
    """A repository's address without what differs between ways to reach it: scheme and user, closing slashes and .git; in lower case.

    Schemes are told in lower case, as the tools write them; another one is part of the name.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), "[.]git$", ""), "^git[+]", "")
    login = F.when(bare.startswith("git@"), F.regexp_replace(F.substr(bare, F.lit(5)), "^([^:]*):", "$1/"))
    return F.lower(F.coalesce(login, F.regexp_replace(bare, "^(ssh://git@|https?://)", "")))


@query(f"""WITH {PATHS}, c AS (SELECT page_id, lower(host) AS host, lower(coalesce(nullif(rtrim(path, '/'), ''), 'r')) AS path FROM paths)
 SELECT page_id, CASE page_id % 8 WHEN 7 THEN 'https://' ELSE '' END || host || '/' || path AS canonical FROM c""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository addresses in one form, so that a repository is one project however it is cloned."""
    path = F.coalesce(F.nullif(F.regexp_replace("path", "/+$", ""), F.lit("")), F.lit("r"))
    form, url = F.col("page_id") % len(_ADDRESSES), F.lit(None).cast("string")
    for k, text in enumerate(_ADDRESSES):
        before, between, after = text.split("{}")
        url = F.when(form == k, F.concat(F.lit(before), "host", F.lit(between), path, F.lit(after))).otherwise(url)
    return paths(spark, sf_dir).select("page_id", canonical_address(url).alias("canonical"))


@query(f"WITH {PATHS} SELECT DISTINCT host || '/' || path AS path, len(string_split(host || '/' || path, '/')) AS depth FROM paths WHERE path <> '' ORDER BY path DESC")
def deepest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths in descending order, in which what is inside a directory comes before it; sorted across partitions by ranges."""
    p = paths(spark, sf_dir).filter("path <> ''").select(F.concat("host", F.lit("/"), "path").alias("path")).distinct()
    return p.withColumn("depth", F.size(F.split("path", "/")).cast("long")).orderBy(F.desc("path"))


@query(f"""WITH {PATHS}, r AS (SELECT page_id, rtrim(path, '/') AS p FROM paths) SELECT page_id, CASE WHEN p = '' THEN '.' ELSE p END AS resolved, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, '/')) END AS depth, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS parent FROM r""")
def path_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with . and .. taken out by folding over their segments, their depth and their parent."""
    messy = F.concat(F.lit("./x/../"), "path")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(F.split(messy, "/"), empty, lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    p = paths(spark, sf_dir).withColumn("parts", folded)
    joined = F.array_join("parts", "/")
    return p.select("page_id", F.when(joined == "", ".").otherwise(joined).alias("resolved"), F.size("parts").cast("long").alias("depth"), F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))), "/").alias("parent"))


#: Segments that a root may lie below the anchor.
MAX_MOUNT_DEPTH = 8


@query(f"""WITH {PATHS}, q AS (SELECT regexp_replace(host, '^[^.]*[.]', '') AS project, host || '/' || path || CASE WHEN page_id % 9 = 0 THEN '/a/b/c/d/e/f/g/h/i' ELSE '' END AS root FROM paths WHERE path <> '' UNION ALL SELECT 'one', 'only/root' UNION ALL SELECT regexp_replace(host, '^[^.]*[.]', ''), host || '/en' FROM paths),
 r AS (SELECT DISTINCT project, root, string_split(root, '/') AS parts FROM q), m AS (SELECT project, string_split(min(root), '/') AS lo, string_split(max(root), '/') AS hi FROM r GROUP BY 1),
 a AS (SELECT project, list_filter(range(1, least(len(lo), len(hi)) + 1), lambda n: lo[1:n] = hi[1:n]) AS ns, lo FROM m), b AS (SELECT project, len(ns) AS n, array_to_string(lo[1:len(ns)], '/') AS anchor FROM a),
 o AS (SELECT r.project, r.root, anchor, array_to_string(parts[n + 1:], '/') AS mount, len(parts) - n AS depth, EXISTS (SELECT 1 FROM r s WHERE s.project = r.project AND starts_with(r.root, s.root || '/')) AS nested FROM r JOIN b USING (project))
 SELECT project, root, anchor, mount, nested, depth > {MAX_MOUNT_DEPTH} AS too_deep, row_number() OVER (PARTITION BY project ORDER BY depth, mount) AS place FROM o""")
def root_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each root of a project is mounted below their common directory."""
    p, deep = paths(spark, sf_dir), F.when(F.col("page_id") % 9 == 0, "/a/b/c/d/e/f/g/h/i").otherwise("")
    project = F.regexp_replace("host", "^[^.]*[.]", "").alias("project")
    roots = p.filter("path <> ''").select(project, F.concat("host", F.lit("/"), "path", deep).alias("root")).unionAll(p.select(project, F.concat("host", F.lit("/en"))))
    return laid_out(roots.unionAll(p.limit(1).select(F.lit("one"), F.lit("only/root"))))


def laid_out(roots: DataFrame) -> DataFrame:
    """project, root, anchor, mount, nested, too_deep and place for each root (project, root), once each.

    The anchor is the deepest directory above all roots (a single root is its own); of sorted paths, the first and last share what all
    share, and roots within others can't move it. A mount is the rest of a root's path; one of more than MAX_MOUNT_DEPTH segments is
    too deep. Outermost mounts come first; the roots of one project are ordered in one task.
    """
    r = roots.select("project", "root").distinct()
    ends = r.groupBy("project").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    a, b = F.split("lo", "/"), F.split("hi", "/")
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)))
    ends = ends.withColumn("n", shared).select("project", "n", F.array_join(F.slice(a, F.lit(1), F.col("n")), "/").alias("anchor"))
    # a root is nested if one of its proper prefixes is a root too
    ups = r.select("project", "root", F.explode(F.array_except(prefixes(F.col("root")), F.array(F.lit(""), F.col("root")))).alias("up"))
    within = ups.join(r.select("project", F.col("root").alias("up")), ["project", "up"]).select("project", "root").distinct().withColumn("_in", F.lit(True))
    placed = r.join(ends, "project").join(within, ["project", "root"], "left").withColumn("parts", F.split("root", "/"))
    placed = placed.withColumn("depth", F.size("parts") - F.col("n")).withColumn("mount", F.array_join(F.slice("parts", F.col("n") + 1, F.greatest(F.col("depth"), F.lit(0))), "/"))
    place = F.row_number().over(Window.partitionBy("project").orderBy("depth", "mount"))
    return placed.select("project", "root", "anchor", "mount", F.col("_in").isNotNull().alias("nested"), (F.col("depth") > MAX_MOUNT_DEPTH).alias("too_deep"), place.alias("place"))


@query(f"""WITH {PATHS} SELECT page_id, (regexp_matches(path, '^en/[^/]*$') AND NOT regexp_matches(path, '^en/[^/]*9$')) OR path = 'fr/825' AS member FROM paths""")
def member_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by glob, without those excluded by another; members named in full aren't excluded."""
    globs, outs, named = ["en/*"], ["en/*9"], ["fr/825"]
    hit = lambda gs: F.col("path").rlike("|".join(to_regex("/" + g)[0] for g in gs))
    return paths(spark, sf_dir).select("page_id", ((hit(globs) & ~hit(outs)) | F.col("path").isin(named)).alias("member"))
