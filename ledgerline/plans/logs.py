"""Log analysis: classification, markup, progress, tests, scrapers and missing dependencies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.adapters import diagnosed
from ..functions.classify import ABSENCE, ENVIRONMENT, ENVIRONMENT_WEAK, PACKAGES, PROGRAMS, REMEDIES, environment_at_fault, missing_dependencies, parses_tests, remedy, told
from ..functions.columns import plain_text
from ..functions.diagnostics import DIAGNOSTIC
from ..operators.logs import LISTED, TAIL, classified, compiler_messages, progress, scraped, summed_tests
from ..sources.telemetry import build_logs, json_logs, lines, load, run_logs, runs, tool_logs
from .base import BUILD_LOGS, LINES, RUN_LOGS, query


def _values(pairs: dict[str, str]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in kv) + ")" for kv in pairs.items())


def _any(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


def _environmental(low: str) -> str:
    return f"({_any(low, ENVIRONMENT)} OR {_any(low, ENVIRONMENT_WEAK)} AND {_any(low, ABSENCE)})"


_DIAGNOSTIC = "regexp_extract(bare, '" + DIAGNOSTIC + "', {})"
#: Facts of each log, as the rules have them: diagnostics and tests of all lines, and the text of the last ones.
_FACTS = f"""b AS (SELECT *, regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g') AS bare FROM logs),
 l AS (SELECT log_id, {_DIAGNOSTIC.format(1)} AS file, {_DIAGNOSTIC.format(4)} AS level, {_DIAGNOSTIC.format(5)} AS message, TRY_CAST(regexp_extract(bare, '^test result:\\s*\\w+\\.\\s*[0-9]+ passed; ([0-9]+) failed', 1) AS BIGINT) AS failed FROM b),
 e AS (SELECT log_id, count(*) FILTER (WHERE level LIKE '%error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings,
  count(*) FILTER (WHERE level LIKE '%error' AND NOT ends_with(file, '.rs') AND (regexp_matches(message, '\\.h(pp)?: No such file') OR regexp_matches(message, 'cannot find -l\\w'))) AS env_errors, coalesce(sum(failed), 0)::BIGINT AS failed FROM l GROUP BY 1),
 s AS (SELECT log_id, line, line_no, max(line_no) OVER (PARTITION BY log_id) AS n FROM logs), t AS (SELECT log_id, string_agg(line, chr(10)) AS tail FROM s WHERE line_no > n - {TAIL} GROUP BY 1),
 f AS (SELECT * FROM e JOIN t USING (log_id))"""
_RULE = f"""CASE WHEN exit_code = 0 AND NOT timed_out THEN 'success' WHEN timed_out THEN 'timeout' WHEN errors > 0 AND env_errors = errors THEN 'env_diagnostics' WHEN errors > 0 THEN 'compile_error'
 WHEN tests AND failed > 0 THEN 'test_failed' WHEN oom THEN 'oom_killed' WHEN contains(tail, '(signal: 9, SIGKILL: kill)') THEN 'sigkill_suspected_oom'
 WHEN contains(tail, 'error: could not compile') AND (contains(tail, '(signal: 11, SIGSEGV') OR contains(tail, '(signal: 6, SIGABRT')) THEN 'rustc_crash'
 WHEN contains(lower(tail), 'no space left on device') THEN 'disk_full' WHEN {_environmental("lower(tail)")} THEN 'env_markers_raw' ELSE 'unknown' END"""
_KIND = "CASE WHEN rule = 'success' THEN 'success' WHEN rule = 'timeout' THEN 'timeout' WHEN rule IN ('compile_error', 'test_failed') THEN 'compile_error' WHEN rule IN ('rustc_crash', 'disk_full') THEN 'infra_error' ELSE 'env_error' END"
_WHOSE = """CASE WHEN rule = 'success' THEN 'none' WHEN rule IN ('timeout', 'rustc_crash', 'disk_full') THEN 'infra' WHEN rule IN ('env_diagnostics', 'env_markers_raw') THEN 'project_config'
 WHEN rule IN ('compile_error', 'test_failed') THEN 'code' WHEN rule IN ('oom_killed', 'sigkill_suspected_oom') THEN 'resource' ELSE 'unknown' END"""
_CLASSIFIED = f"""{RUN_LOGS}, {_FACTS}, g AS (SELECT r.log_id, exit_code, timed_out, oom, tests, few_jobs, coalesce(tail, '') AS tail, coalesce(errors, 0) AS errors, coalesce(env_errors, 0) AS env_errors, coalesce(warnings, 0) AS warnings, coalesce(failed, 0) AS failed
 FROM runs r LEFT JOIN f ON r.log_id = f.log_id), c AS (SELECT *, {_RULE} AS rule FROM g)"""


@query(f"""WITH {_CLASSIFIED} SELECT log_id, rule, {_KIND} AS kind, {_WHOSE} AS attribution, errors, warnings, {_environmental("lower(tail)")} AS environmental FROM c""")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of eleven rules that each run meets, by how it ended and by its log, with the kind of result and whom it is put down to."""
    ended = runs(spark, sf_dir).withColumn("tests", parses_tests(F.col("task"), F.col("override"), F.col("profile_command")))
    return classified(run_logs(spark, sf_dir), ended.select("log_id", "exit_code", "timed_out", "oom", "tests"))


@query(f"""WITH {_CLASSIFIED} SELECT log_id, rule, '2' AS jobs FROM c WHERE rule IN ('oom_killed', 'sigkill_suspected_oom') AND NOT few_jobs""")
def remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that are tried once more with a changed environment: those that ran out of memory, unless they had that environment already."""
    ended = runs(spark, sf_dir).withColumn("tests", parses_tests(F.col("task"), F.col("override"), F.col("profile_command")))
    verdicts = classified(run_logs(spark, sf_dir), ended.select("log_id", "exit_code", "timed_out", "oom", "tests"))
    again = verdicts.filter(F.col("rule").isin(*REMEDIES)).join(ended.select("log_id", "env"), "log_id").withColumn("env", remedy(F.col("rule"), F.col("env")))
    return again.filter("env IS NOT NULL").select("log_id", "rule", F.element_at("env", "CARGO_BUILD_JOBS").alias("jobs"))


# The environment that tests have unless a run says otherwise.
TEST_ENV = {"CARGO_PROFILE_TEST_DEBUG": "0", "CARGO_PROFILE_DEV_DEBUG": "0"}


def outcomes(logs: DataFrame, ended: DataFrame) -> DataFrame:
    """log_id, outcome (tests, success or custom), passed, failed and env of each run, by the contract of its task.

    ended: log_id, exit_code, task, tests (whether its log may be read for test results) and env. Only a test whose command is the
    default one is judged by its summary; all else by its exit code. What the run sets in its environment goes before the task's own.
    """
    seen = summed_tests(logs).select("log_id", "passed", "failed")
    judged = ended.join(seen, "log_id", "left").withColumn("read", F.col("tests") & F.col("passed").isNotNull())
    own = F.create_map(*[F.lit(x) for kv in TEST_ENV.items() for x in kv])
    env = F.when(F.col("task") == "test", F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key("env", k)), "env")).otherwise(F.col("env"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(env), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    count = lambda c: F.when(F.col("read"), F.col(c))
    return judged.select("log_id", F.when(F.col("read"), "tests").when(F.col("exit_code") == 0, "success").otherwise("custom").alias("outcome"), count("passed").alias("passed"), count("failed").alias("failed"), text.alias("env"))


@query(f"""WITH {RUN_LOGS}, s AS (SELECT log_id, sum(CAST(regexp_extract(line, '([0-9]+) passed', 1) AS BIGINT))::BIGINT AS passed, sum(CAST(regexp_extract(line, '([0-9]+) failed', 1) AS BIGINT))::BIGINT AS failed FROM logs WHERE starts_with(line, 'test result:') GROUP BY 1)
 SELECT r.log_id, CASE WHEN tests AND passed IS NOT NULL THEN 'tests' WHEN exit_code = 0 THEN 'success' ELSE 'custom' END AS outcome, CASE WHEN tests THEN passed END AS passed, CASE WHEN tests THEN failed END AS failed,
 array_to_string(list_sort(list_filter([CASE WHEN few_jobs THEN 'CARGO_BUILD_JOBS=2' END, CASE WHEN r.log_id % 3 = 0 THEN 'CARGO_PROFILE_TEST_DEBUG=0' END, CASE WHEN r.log_id % 3 = 0 THEN 'CARGO_PROFILE_DEV_DEBUG=0' END], lambda x: x IS NOT NULL)), ',') AS env FROM runs r LEFT JOIN s ON s.log_id = r.log_id""")
def outcome_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract of its task makes of each run, and the environment it ran in."""
    ended = runs(spark, sf_dir).withColumn("tests", parses_tests(F.col("task"), F.col("override"), F.col("profile_command")))
    return outcomes(run_logs(spark, sf_dir), ended)


@query(
    f"""WITH {BUILD_LOGS}, {_FACTS}, c AS (SELECT *, 101 AS exit_code, false AS timed_out, true AS tests, false AS oom FROM f), d AS (SELECT *, {_RULE} AS rule FROM c)
 SELECT log_id, rule, {_KIND} AS kind, {_WHOSE} AS attribution, errors, warnings, {_environmental("lower(tail)")} AS environmental FROM d"""
)
def classify_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that each log of a failed build meets first."""
    return classified(build_logs(spark, sf_dir))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '<[^<>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g') AS text FROM pages")
def markup_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without markup, white space runs as one space."""
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", "<[^<>]*>", " "), "[ \\t\\n\\r]+", " ").alias("text"))


@query(f"""WITH {BUILD_LOGS} SELECT log_id, line_no, regexp_replace(regexp_replace(line, chr(27) || '\\][^' || chr(7) || ']*' || chr(7), '', 'g'), chr(27) || '\\[[0-9;]*m', '', 'g') AS line FROM logs""")
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without colours, links and cut-off escape sequences."""
    return build_logs(spark, sf_dir).withColumn("line", plain_text(F.col("line")))


@query(
    f"""WITH {BUILD_LOGS}, programs(low, package) AS (VALUES {_values(PROGRAMS)}), packages(low, package) AS (VALUES {_values(PACKAGES)}),
 h AS (SELECT log_id, line_no, CASE WHEN starts_with(line, 'bash: ') THEN regexp_extract(line, '^bash: (.*): command not found$', 1) WHEN starts_with(line, '/usr/bin/ld') THEN regexp_extract(line, '-l(.*)$', 1) ELSE regexp_extract(line, chr(39) || '(.*)' || chr(39), 1) END AS name,
  CASE WHEN starts_with(line, 'bash: ') THEN 'program' WHEN starts_with(line, '/usr/bin/ld') THEN 'library' ELSE 'pkg-config' END AS kind FROM logs WHERE starts_with(line, 'bash: ') OR starts_with(line, '/usr/bin/ld') OR starts_with(line, 'No package ')),
 t AS (SELECT log_id, name, kind = 'program' AS tool, arg_min(kind, line_no) AS kind, min(line_no) AS first FROM h WHERE length(name) <= 64 GROUP BY 1, 2, 3),
 r AS (SELECT *, regexp_replace(name, '^lib', '') AS bare, row_number() OVER (PARTITION BY log_id ORDER BY first, name) AS place FROM t)
 SELECT log_id, name, kind, CASE WHEN tool THEN o.package ELSE coalesce(a.package, b.package, CASE WHEN bare <> '' THEN 'lib' || bare || '-dev' END) END AS package,
  CASE WHEN tool THEN o.package IS NOT NULL ELSE coalesce(a.package, b.package) IS NOT NULL END AS certain, place FROM r LEFT JOIN programs o ON o.low = name LEFT JOIN packages a ON a.low = name LEFT JOIN packages b ON b.low = bare WHERE place <= 12"""
)
def missing_dep_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each log says is missing, with the package that would bring it."""
    return missing_dependencies(build_logs(spark, sf_dir))


@query(f"""WITH {BUILD_LOGS}, u AS (SELECT log_id, line_no, regexp_extract(line, '^\\s*(?:Compiling|Checking) (\\S+) v', 1) AS unit FROM logs) SELECT log_id, count(*) AS units, arg_max(unit, line_no) AS current FROM u WHERE unit <> '' GROUP BY 1""")
def unit_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that each log has seen, and the current one."""
    return progress(build_logs(spark, sf_dir))


@query(
    f"""WITH {BUILD_LOGS}, m AS (SELECT *, CASE WHEN line = 'failures:' THEN 1 WHEN NOT regexp_matches(line, '^    \\S') THEN 0 END AS mark, nullif(regexp_extract(line, '^\\s*Running (\\S+)', 1), '') AS b FROM logs),
 k AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS inside, last_value(b IGNORE NULLS) OVER w AS bin FROM m WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
 n AS (SELECT log_id, concat_ws('::', regexp_extract(bin, '([^/]+?)(?:\\.rs)?$', 1), trim(line)) AS name, row_number() OVER (PARTITION BY log_id ORDER BY line_no) AS n FROM k WHERE mark IS NULL AND inside = 1),
 l AS (SELECT log_id, string_agg(name, ',' ORDER BY n) FILTER (WHERE n <= {LISTED}) AS names, max(n) > {LISTED} AS truncated FROM n GROUP BY 1),
 s AS (SELECT log_id, sum(CAST(regexp_extract(line, '([0-9]+) passed', 1) AS BIGINT))::BIGINT AS passed, sum(CAST(regexp_extract(line, '([0-9]+) failed', 1) AS BIGINT))::BIGINT AS failed,
  sum(CAST(regexp_extract(line, '([0-9]+) ignored', 1) AS BIGINT))::BIGINT AS ignored, count(*) AS binaries FROM logs WHERE starts_with(line, 'test result:') GROUP BY 1)
 SELECT s.*, coalesce(names, '') AS names, coalesce(truncated, false) AS truncated FROM s LEFT JOIN l ON s.log_id = l.log_id"""
)
def test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed, failed and ignored tests of each log, and the names of failures with their binaries, twenty at most."""
    return summed_tests(build_logs(spark, sf_dir))


@query(
    f"""WITH {RUN_LOGS}, b AS (SELECT log_id, line_no, regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g') AS bare FROM logs)
 SELECT log_id, line_no, {_DIAGNOSTIC.format(1)} AS file, CAST({_DIAGNOSTIC.format(2)} AS INTEGER) AS line, coalesce(TRY_CAST({_DIAGNOSTIC.format(3)} AS INTEGER), 0) AS "column", CASE {_DIAGNOSTIC.format(4)} WHEN 'warning' THEN 'warning' ELSE 'error' END AS level, trim({_DIAGNOSTIC.format(5)}) AS message
 FROM b WHERE regexp_matches(bare, '{DIAGNOSTIC}')"""
)
def generic_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of the form file:line[:column]: level: message, of coloured and indented lines too; a fatal error is an error."""
    return scraped(run_logs(spark, sf_dir))


# what each form of a JSON line comes to: null where it is no message, or one that says nothing of its own
_JSON_FORMS = f"""{LINES}, worded AS (SELECT log_id, line_no, length(line) AS n, regexp_extract(line, '[A-Za-z]+') AS w FROM lines),
 m AS (SELECT log_id, line_no, n % 12 AS form, n, w, lower(w) AS low FROM worded WHERE w <> '' AND n % 12 IN (0, 1, 8, 9, 10, 11))"""


@query(
    f"""WITH {_JSON_FORMS} SELECT log_id, line_no, CASE form WHEN 1 THEN 'warning' ELSE 'error' END AS level, CASE form WHEN 0 THEN 'E0308' ELSE '' END AS code, 'about ' || w AS message,
 CASE WHEN form IN (0, 1, 10) THEN 'src/' || w || '.rs' WHEN form = 9 THEN low || '.c' ELSE '' END AS file, CAST(CASE WHEN form IN (0, 1, 9, 10) THEN n ELSE 0 END AS INTEGER) AS line, CAST(CASE WHEN form IN (0, 1, 9, 10) THEN 5 ELSE 0 END AS INTEGER) AS "column",
 replace(CASE form WHEN 0 THEN 'error: about ' || w WHEN 1 THEN 'warning' WHEN 8 THEN 'error: linking with `cc` failed|  ¦|  = note: /usr/bin/ld: warning: odd|          /usr/bin/ld: cannot find -l' || low || '||'
  WHEN 9 THEN 'error: mismatched|  --> a.c:1| 1 ¦ let s = "cannot find -l' || low || '";|  = help: ask ' || w WHEN 10 THEN 'error: x|  = note: cannot find -l' || low ELSE 'error: x|  = note: see|  --> a.c:1|    cannot find -l' || low || '|  = help: none' END, '|', chr(10)).replace('¦', '|') AS rendered,
 form = 8 AS environmental FROM m"""
)
def json_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a compiler's JSON stream reports: the primary place of each message, and whether its evidence puts it down to the environment.

    Notes are followed over their lines; quoted source never counts, nor does anything about a Rust file.
    """
    return compiler_messages(json_logs(spark, sf_dir))


@query(f"""WITH {RUN_LOGS}, b AS (SELECT log_id, line_no, regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g') AS bare FROM logs), d AS (SELECT log_id, line_no, {_DIAGNOSTIC.format(1)} AS file, {_DIAGNOSTIC.format(5)} AS message FROM b WHERE regexp_matches(bare, '{DIAGNOSTIC}'))
 SELECT log_id, line_no, NOT ends_with(file, '.rs') AND (regexp_matches(message, '\\.h(pp)?: No such file') OR regexp_matches(message, 'cannot find -l\\w')) AS environmental FROM d""")
def env_diag_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each diagnostic in text is the environment's fault: one that names a header or a library, and isn't of a Rust source."""
    return scraped(run_logs(spark, sf_dir)).select("log_id", "line_no", environment_at_fault(F.col("file"), F.col("message")).alias("environmental"))


# run logs beside other lines: two of their steps go by other names
_RUN_LOGS_TOO = RUN_LOGS.replace("lines AS (", "run_lines AS (").replace("FROM lines)", "FROM run_lines)").replace("worded AS (", "run_worded AS (").replace("FROM worded WHERE", "FROM run_worded WHERE")


@query(
    f"""WITH {_JSON_FORMS}, {_RUN_LOGS_TOO},
 b AS (SELECT log_id, line_no, regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g') AS bare FROM logs)
 SELECT 'cargo' AS adapter, log_id, line_no, CASE form WHEN 1 THEN 'warning' ELSE 'error' END AS level, CASE form WHEN 0 THEN 'E0308' ELSE '' END AS code, 'about ' || w AS message,
 CASE WHEN form IN (0, 1, 10) THEN 'src/' || w || '.rs' WHEN form = 9 THEN low || '.c' ELSE '' END AS file, CAST(CASE WHEN form IN (0, 1, 9, 10) THEN n ELSE 0 END AS INTEGER) AS line, CAST(CASE WHEN form IN (0, 1, 9, 10) THEN 5 ELSE 0 END AS INTEGER) AS "column" FROM m
 UNION ALL SELECT 'generic', log_id, line_no, CASE {_DIAGNOSTIC.format(4)} WHEN 'warning' THEN 'warning' ELSE 'error' END, '', trim({_DIAGNOSTIC.format(5)}), {_DIAGNOSTIC.format(1)}, CAST({_DIAGNOSTIC.format(2)} AS INTEGER), coalesce(TRY_CAST({_DIAGNOSTIC.format(3)} AS INTEGER), 0) FROM b WHERE regexp_matches(bare, '{DIAGNOSTIC}')"""
)
def adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnostics of logs by either adapter, out of a table function that is told the adapter's name."""
    one, two = diagnosed(json_logs(spark, sf_dir), "cargo"), diagnosed(run_logs(spark, sf_dir), "generic")
    return one.select(F.lit("cargo").alias("adapter"), "*").unionByName(two.select(F.lit("generic").alias("adapter"), "*"))


# name and kind that each form of a tool's line tells; forms that tell nothing are left out
_TOLD = """ VALUES (0, 'pkg-config', '', ''), (1, 'pkg-config', '', ''), (2, 'pkg-config', '', ' >= 3'), (3, 'library', '', ''), (4, 'library', '', ''), (5, 'header', '/', '.h'), (6, 'header', '', '.hpp'), (7, 'program', '', ''), (8, 'program', '', ''), (9, 'program', '', ''),
 (11, 'program', '', ''), (12, 'program', '', ''), (13, 'program', '', ''), (14, 'prose', 'lib', ''), (15, 'prose', 'lib', ''), (16, 'prose', 'lib', ''), (18, 'build-script', '', ' v1'), (20, 'library', '', '')"""


@query(
    f"""WITH {LINES}, worded AS (SELECT log_id, line_no, length(line) % 23 AS form, lower(regexp_extract(line, '[A-Za-z]+')) AS w FROM lines), told(form, kind, before, after) AS ({_TOLD}),
 f AS (SELECT log_id, CASE kind WHEN 'prose' THEN 'pkg-config' ELSE kind END AS kind, CASE before WHEN '/' THEN w || '/' ELSE before END || w || after AS name, CASE kind WHEN 'prose' THEN 1 WHEN 'build-script' THEN 0 ELSE 2 END AS weight FROM worded JOIN told USING (form) WHERE w <> '')
 SELECT kind, name, count(*) AS lines, max(weight)::INTEGER AS weight FROM f GROUP BY 1, 2"""
)
def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form in which a tool says that something is missing, by what is missing: how many lines say so, and how good their evidence is at best.

    Lines of JSON, errors of files, numbers of lines and prose about nothing that is known say nothing.
    """
    return told(tool_logs(spark, sf_dir)).groupBy("kind", "name").agg(F.count("*").alias("lines"), F.max("weight").alias("weight"))


# What a manifest or build script may name, and the packages that it then needs.
HINTS = {
    "protobuf_src": "protobuf-compiler", "prost-build": "protobuf-compiler", "tonic-build": "protobuf-compiler", "protoc": "protobuf-compiler", "pkg-config": "pkg-config",
    "openssl-sys": "libssl-dev pkg-config", "libsqlite3-sys": "libsqlite3-dev", "libgit2-sys": "libgit2-dev", "cmake": "cmake", "bindgen": "libclang-dev", "cc::Build": "build-essential",
}


def hinted(manifests: DataFrame, hints: dict[str, str]) -> DataFrame:
    """id and package, each once, for what the text of each manifest (id, text) names; a null text names nothing."""
    found = F.array_distinct(F.filter(F.array(*[F.when(F.contains("text", F.lit(n)), F.lit(p)) for n, p in hints.items()]), lambda x: x.isNotNull()))
    return manifests.select("id", F.explode(found).alias("package"))


@query(
    """WITH m AS (SELECT p_partkey AS id, 'name = "' || p_name || '"' || chr(10) || '[dependencies]' || chr(10) || ['prost-build', 'openssl-sys', 'serde', 'libgit2-sys', 'protoc-rust', 'bindgen'][1 + p_size % 6] || ' = "1"' || chr(10) || CASE WHEN p_size % 5 = 0 THEN 'tonic-build = "2"' ELSE 'build = cc::Build' END AS text FROM part),
 h(needle, package) AS (VALUES """
    + _values(HINTS)
    + """) SELECT DISTINCT id, package FROM m JOIN h ON contains(text, needle)"""
)
def system_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System packages that each manifest hints at, each once; manifests are made of parts."""
    crates = F.array(*map(F.lit, ("prost-build", "openssl-sys", "serde", "libgit2-sys", "protoc-rust", "bindgen")))
    text = F.concat(F.lit('name = "'), "p_name", F.lit('"\n[dependencies]\n'), F.element_at(crates, 1 + F.col("p_size") % 6), F.lit(' = "1"\n'), F.when(F.col("p_size") % 5 == 0, 'tonic-build = "2"').otherwise("build = cc::Build"))
    return hinted(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")), HINTS)


@query(f"""WITH {LINES}, h AS (SELECT log_id, min(line_no) FILTER (WHERE contains(lower(line), 'the')) AS first_hit, max(line_no) AS n FROM lines GROUP BY 1) SELECT log_id, coalesce(first_hit, 0) AS line_no, n AS lines FROM h""")
def line_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the first line that holds a needle, 0 if none does."""
    hit = F.min(F.when(F.contains(F.lower("line"), F.lit("the")), F.col("line_no")))
    return lines(spark, sf_dir).groupBy("log_id").agg(F.coalesce(hit, F.lit(0)).alias("line_no"), F.max("line_no").alias("lines"))


@F.pandas_udf(StringType())
def cut_bytes(text: pd.Series, most: pd.Series) -> pd.Series:
    """A text's longest prefix of at most so many UTF-8 bytes."""
    return pd.Series([None if t is None else t.encode()[:n].decode(errors="ignore") for t, n in zip(text, most, strict=True)])


@F.pandas_udf(StringType())
def elide(line: pd.Series, most: pd.Series) -> pd.Series:
    """A line over a byte budget as its head and tail, five to two, with the bytes left out between them."""
    out = []
    for s, n in zip(line, most, strict=True):
        b = None if s is None else s.encode()
        if b is None or len(b) <= n:
            out.append(s)
            continue
        room = max(n - len(f" …[{len(b)} bytes]… ".encode()), 0)
        head = b[: room * 5 // 7].decode(errors="ignore")
        tail = b[len(b) - room * 2 // 7 :].decode(errors="ignore") if room * 2 // 7 else ""
        out.append(f"{head} …[{len(b) - len(head.encode()) - len(tail.encode())} bytes]… {tail}")
    return pd.Series(out)


#: Bytes of a packed log, and of a line before it is elided.
BUDGET, LINE_BUDGET = 8192, 400


def packed(logs: DataFrame) -> DataFrame:
    """log_id, slot, line_no and text of what a log's budget holds, of all lines of `logs` (log_id, line_no, line).

    Slots in order of their claim: 0 headline (the first line), 1 critical (errors E7), 2 diagnostics (other errors), 3 notices
    (warnings), 4 the rest; level and code come from a line's length as in `diagnostics`. A line takes its bytes and one for its end.
    So headline and critical are reserved before others get room, and the line that exceeds the budget is cut at a whole character.
    """
    n = F.length("line")
    error, e7 = n % 3 == 0, (n % 5 != 0) & (n % 11 == 7)
    slot = F.when(F.col("line_no") == 1, 0).when(F.trim("line") == "", 4).when(error & e7, 1).when(error, 2).when(n % 3 == 1, 3).otherwise(4)
    parted = logs.select("log_id", "line_no", slot.alias("slot"), F.col("line").alias("text"))
    # few lines are too long, and only those are handed to Python
    long_ = F.octet_length("text") > LINE_BUDGET
    slots = parted.filter(~long_).unionByName(parted.filter(long_).withColumn("text", elide(F.col("text"), F.lit(LINE_BUDGET))))
    used = F.expr("sum(octet_length(text) + 1) OVER (PARTITION BY log_id ORDER BY slot, line_no ROWS UNBOUNDED PRECEDING)")
    room = F.lit(BUDGET) - (used - F.octet_length("text") - 1)
    return slots.withColumn("room", room.cast("int")).filter("room > 0").select("log_id", "slot", "line_no", cut_bytes(F.col("text"), F.col("room")).alias("text"))


_FIT = "list_max(list_filter(range(0, least(length({0}), {1}) + 1), lambda i: strlen({2}({0}, i)) <= {1}))"


@query(
    f"""WITH {LINES}, l AS (SELECT log_id, line_no, line, strlen(line) AS b, length(line) AS n, greatest({LINE_BUDGET} - strlen(' …[' || strlen(line) || ' bytes]… '), 0) AS room FROM lines),
 h AS (SELECT *, CASE WHEN b > {LINE_BUDGET} THEN left(line, {_FIT.format("line", "(room * 5 // 7)", "left")}) END AS head, CASE WHEN b > {LINE_BUDGET} THEN right(line, {_FIT.format("line", "(room * 2 // 7)", "right")}) END AS tail FROM l),
 t AS (SELECT log_id, line_no, CASE WHEN b <= {LINE_BUDGET} THEN line ELSE head || ' …[' || (b - strlen(head) - strlen(tail)) || ' bytes]… ' || tail END AS text,
  CASE WHEN line_no = 1 THEN 0 WHEN trim(line) = '' THEN 4 WHEN n % 3 = 0 AND n % 5 <> 0 AND n % 11 = 7 THEN 1 WHEN n % 3 = 0 THEN 2 WHEN n % 3 = 1 THEN 3 ELSE 4 END AS slot FROM h),
 u AS (SELECT *, {BUDGET} - coalesce(sum(strlen(text) + 1) OVER (PARTITION BY log_id ORDER BY slot, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over FROM t),
 c AS (SELECT log_id, slot, CASE WHEN strlen(text) <= left_over THEN text ELSE left(text, {_FIT.format("text", "left_over", "left")}) END AS text FROM u WHERE left_over > 0)
 SELECT log_id, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT CASE WHEN length(text) > 0 THEN slot END) AS slots FROM c GROUP BY 1"""
)
def budget_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of text and slots in use of each log when all of its lines are packed into its budget."""
    return packed(lines(spark, sf_dir)).groupBy("log_id").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct(F.when(F.length("text") > 0, F.col("slot"))).alias("slots"))
