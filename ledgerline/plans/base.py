"""The register of queries, and the stand-ins for telemetry tables as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Tasks out of events; see sources.telemetry.tasks.
TASKS = """tasks AS (SELECT event_id AS id, epoch_us(ts) AS at_us, epoch_us(ts) // 1000000 AS at_s, user_id AS project, 'w' || (user_id % 7) AS worktree,
 event_type, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'compile_error' WHEN 'click' THEN 'env_error' WHEN 'error' THEN 'infra_error' ELSE 'timeout' END AS result_kind,
 CASE event_id % 10 WHEN 6 THEN 'failed' WHEN 7 THEN 'queued' WHEN 8 THEN 'running' WHEN 9 THEN 'canceled' ELSE 'done' END AS status,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value * 100) AS BIGINT) AS build_ms, (event_id * 13) % 700 AS queue_ms, (event_id * 7) % 300 AS sync_ms, value FROM events),
now AS (SELECT max(at_us) AS us, max(at_s) AS s FROM tasks)"""
#: Log lines out of documents.
LINES = """lines AS (SELECT doc_id AS log_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"""
#: Build output out of log lines; see sources.telemetry.build_logs.
BUILD_LOGS = (
    LINES
    + """,
worded AS (SELECT log_id, line_no, length(line) AS n, regexp_extract(line, '[A-Za-z]+') AS w FROM lines),
logs AS (SELECT log_id, line_no, CASE n % 13
 WHEN 0 THEN concat('   Compiling ', w, ' v0.', n % 7, '.0') WHEN 1 THEN concat('   Checking ', w, ' v1.', n % 7, '.0')
 WHEN 2 THEN concat('src/', w, '.rs:', n, ':5: error: ', w, ' is unknown') WHEN 3 THEN concat(w, '.c:', n, ': warning: unused ', w)
 WHEN 4 THEN concat('test result: FAILED. ', n % 17, ' passed; ', n % 3, ' failed; ', n % 2, ' ignored')
 WHEN 5 THEN concat(chr(27), '[31m', w, chr(27), '[0m') WHEN 6 THEN concat('bash: ', lower(w), ': command not found')
 WHEN 7 THEN concat('/usr/bin/ld: cannot find -l', lower(w)) WHEN 8 THEN concat('No package ''', lower(w), ''' found')
 WHEN 9 THEN concat(chr(27), ']8;;http://', w, chr(7), w) WHEN 10 THEN 'failures:' WHEN 11 THEN concat('    ', w)
 ELSE concat('     Running tests/', w, '.rs') END AS line FROM worded WHERE w <> '')"""
)
#: Logs of runs, and how they ended; see sources.telemetry.run_logs and runs.
RUN_LOGS = """split AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN string_split(replace(text, ' ', chr(10)), chr(10)) ELSE string_split(text, chr(10)) END AS parts FROM documents),
lines AS (SELECT doc_id AS log_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM split),
worded AS (SELECT log_id, line_no, length(line) AS n, regexp_extract(line, '[A-Za-z]+') AS w FROM lines),
code AS (SELECT *, concat('src/', w, '.rs:', n, ':5: error: ', w, ' is unknown') AS code,
 concat(chr(27), '[1m  my dir/', lower(w), '.c:', n, ': fatal error: openssl/', lower(w), '.h: No such file or directory', chr(27), '[0m') AS header FROM worded WHERE w <> ''),
logs AS (SELECT log_id, line_no, CASE WHEN n % 4 <> 0 THEN concat('note: ', lower(w)) WHEN log_id % 28 = 8 AND line_no <= 20 THEN code ELSE CASE log_id % 14 WHEN 0 THEN concat('   Compiling ', w, ' v0.1.0') WHEN 1 THEN code WHEN 2 THEN header
 WHEN 3 THEN concat('test result: FAILED. ', n, ' passed; 2 failed; 0 ignored') WHEN 4 THEN 'process didn''t exit successfully: `rustc` (signal: 9, SIGKILL: kill)'
 WHEN 5 THEN concat('error: could not compile `', lower(w), '` (signal: 11, SIGSEGV: invalid memory reference)') WHEN 6 THEN concat('error: could not compile `', lower(w), '` (signal: 6, SIGABRT: process abort signal)')
 WHEN 7 THEN 'write: No space left on device' WHEN 8 THEN concat('bash: ', lower(w), ': command not found') WHEN 9 THEN concat(lower(w), '.c:', n, ': warning: unused ', w)
 WHEN 10 THEN 'rustc exited (signal: 11, SIGSEGV: invalid memory reference)' WHEN 11 THEN concat(lower(w), '.c:', n, ':1: error: the toolchain for ', lower(w), ' was not found')
 WHEN 12 THEN concat(lower(w), '.c:', n, ': error: /usr/bin/ld: cannot find -l', lower(w)) ELSE CASE WHEN n % 8 = 0 THEN code ELSE header END END END AS line FROM code),
runs AS (SELECT doc_id AS log_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 101 END AS exit_code, doc_id % 13 = 1 AS timed_out, doc_id % 7 = 3 AS oom,
 doc_id % 3 = 0 AND doc_id % 8 <> 2 AND doc_id % 9 <> 6 AS tests, doc_id % 2 = 0 AS few_jobs FROM documents)"""
#: Diagnostics out of log lines: level, code and key by their lengths.
DIAGS = (
    LINES
    + """,
diags AS (SELECT log_id, line_no AS pos, line AS message, CASE length(line) % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level,
 CASE WHEN length(line) % 5 = 0 THEN '' ELSE 'E' || (length(line) % 11) END AS code FROM lines WHERE length(trim(line)) > 0)"""
)
#: Paths out of page urls.
PATHS = """paths AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+/?', ''), '[?#].*$', '') AS path, url FROM pages)"""
