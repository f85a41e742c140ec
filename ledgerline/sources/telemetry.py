"""Telemetry tables out of the data folders' tables: tasks, blobs, references, images, workers, logs, diagnostics and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Result kinds that stand for event types.
KINDS = {"purchase": "success", "view": "compile_error", "click": "env_error", "error": "infra_error", "signup": "timeout"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(scan: DataFrame) -> DataFrame:
    """A table as read, its rows dealt over all cores where it is so small that Spark would cut it into fewer parts than there are.

    Such a table has less than 4 MB a core (spark.sql.files.openCostInBytes), often in one row group, which one task would work
    through alone. Larger ones stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per task: id, times, project, worktree, kind of result, status, phases in milliseconds and a payload number k."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return (
        load(spark, sf_dir, "events")
        .withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
        .select(
            F.col("event_id").alias("id"), "at_us", F.expr("at_us div 1000000").alias("at_s"), F.col("user_id").alias("project"), F.expr("concat('w', user_id % 7)").alias("worktree"),
            "event_type", F.coalesce(kind[F.col("event_type")], F.lit("timeout")).alias("result_kind"),
            F.expr("CASE event_id % 10 WHEN 6 THEN 'failed' WHEN 7 THEN 'queued' WHEN 8 THEN 'running' WHEN 9 THEN 'canceled' ELSE 'done' END").alias("status"),
            F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor(F.col("value") * 100).cast("long").alias("build_ms"),
            F.expr("(event_id * 13) % 700").alias("queue_ms"), F.expr("(event_id * 7) % 300").alias("sync_ms"), "value",
        )
    )


def as_of(frame: DataFrame, column: str = "at_us") -> Column:
    """The latest time in a table, which stands for now: one number, found when the query runs."""
    return frame.agg(F.coalesce(F.max(column), F.lit(0)).alias("now")).scalar()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, numbered from 1."""
    docs = dealt(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("log_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def build_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build output with a line for each log line that has a word: its form comes from the line's length, its names from that word."""
    n, w = F.length("line"), F.regexp_extract("line", "[A-Za-z]+", 0)
    low, text = F.lower(w), lambda x: x.cast("string")
    forms = [
        ("   Compiling ", w, " v0.", text(n % 7), ".0"), ("   Checking ", w, " v1.", text(n % 7), ".0"),
        ("src/", w, ".rs:", text(n), ":5: error: ", w, " is unknown"), (w, ".c:", text(n), ": warning: unused ", w),
        ("test result: FAILED. ", text(n % 17), " passed; ", text(n % 3), " failed; ", text(n % 2), " ignored"),
        ("\x1b[31m", w, "\x1b[0m"), ("bash: ", low, ": command not found"), ("/usr/bin/ld: cannot find -l", low), ("No package '", low, "' found"),
        ("\x1b]8;;http://", w, "\x07", w), ("failures:",), ("    ", w), ("     Running tests/", w, ".rs"),
    ]
    out = F.lit(None).cast("string")
    for k, parts in enumerate(forms):
        out = F.when(n % len(forms) == k, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(out)
    return lines(spark, sf_dir).filter(w != "").select("log_id", "line_no", out.alias("line"))


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of runs that each failed in one way or two, by the log's number; other lines are notes.

    Every third log has a line for each word of its document, the others one for each of its lines, so that many are longer than a log's end. In a long
    log some ways are told of at its start only.
    """
    docs = dealt(load(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = F.when(F.col("doc_id") % 3 == 2, F.split("text", "[\\n ]")).otherwise(F.split("text", "\n"))
    rows = docs.select(F.col("doc_id").alias("log_id"), F.posexplode(pieces).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    # found once a line: most forms name the word, and generated code with a search in each is too long to be compiled
    rows = rows.select("log_id", "line_no", F.length("line").alias("n"), F.regexp_extract("line", "[A-Za-z]+", 0).alias("w")).filter("w <> ''").withColumn("low", F.lower("w"))
    n, w, low, text = F.col("n"), F.col("w"), F.col("low"), F.col("n").cast("string")
    code = ("src/", w, ".rs:", text, ":5: error: ", w, " is unknown")
    header = ("\x1b[1m  my dir/", low, ".c:", text, ": fatal error: openssl/", low, ".h: No such file or directory\x1b[0m")
    ways = [
        ("   Compiling ", w, " v0.1.0"), code, header, ("test result: FAILED. ", text, " passed; 2 failed; 0 ignored"),
        ("process didn't exit successfully: `rustc` (signal: 9, SIGKILL: kill)",), ("error: could not compile `", low, "` (signal: 11, SIGSEGV: invalid memory reference)"),
        ("error: could not compile `", low, "` (signal: 6, SIGABRT: process abort signal)"), ("write: No space left on device",), ("bash: ", low, ": command not found"),
        (low, ".c:", text, ": warning: unused ", w), ("rustc exited (signal: 11, SIGSEGV: invalid memory reference)",),
        (low, ".c:", text, ":1: error: the toolchain for ", low, " was not found"), (low, ".c:", text, ": error: /usr/bin/ld: cannot find -l", low),
    ]
    join = lambda parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    way = F.col("log_id") % 14
    out = join(("note: ", low))
    for k, parts in enumerate(ways):
        out = F.when((n % 4 == 0) & (way == k), join(parts)).otherwise(out)
    # the last way: code and environment are both at fault; and one that says two things, one of them early
    out = F.when(way == 13, F.when(n % 8 == 0, join(code)).when(n % 8 == 4, join(header)).otherwise(join(("note: ", low)))).otherwise(out)
    out = F.when((way == 8) & (F.col("log_id") % 28 == 8) & (F.col("line_no") <= 20) & (n % 4 == 0), join(code)).otherwise(out)
    return rows.select("log_id", "line_no", out.alias("line"))


def json_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of a compiler that is asked for JSON: messages of all levels, with and without spans, among artifacts, cut-off lines and text."""
    n, w = F.length("line"), F.regexp_extract("line", "[A-Za-z]+", 0)
    low, text = F.lower(w), n.cast("string")
    span = lambda file, primary, row: ('{"file_name": "', *file, '", "is_primary": ' + primary + ', "line_start": ', *row, ', "column_start": 5, "byte_start": 1}')
    message = lambda level, code, spans, rendered: ('{"reason": "compiler-message", "target": {"name": "x"}, "message": {', *level, '"code": ' + code + ', "children": [], "message": "about ', w, '", "rendered": "', *rendered, '", "spans": [', *spans, "]}}")
    rs, c = ("src/", w, ".rs"), (low, ".c")
    forms = [
        message(('"level": "error", ',), '{"code": "E0308"}', (*span(("lib.rs",), "false", ("1",)), ", ", *span(rs, "true", (text,))), ("\\u001b[31merror\\u001b[0m: about ", w)),
        message(('"level": "warning", ',), "null", (*span(rs, "false", (text,)), ", ", *span(("lib.rs",), "false", ("9",))), ("warning",)),
        message(('"level": "note", ',), "null", (), ("note",)), message(('"level": "failure-note", ',), "null", (), ("note",)), message(('"level": "help", ',), "null", (), ("help",)),
        ('{"reason": "compiler-artifact", "features": ["pkg-config"], "target": {"name": "', w, '"}}'), ('{"reason": "compiler-message", "message": {"level": "error", "message": "', w), ("error: plain ", w),
        message(('"level": "error", ',), "null", (), ("error: linking with `cc` failed\\n  |\\n  = note: /usr/bin/ld: warning: odd\\n          /usr/bin/ld: cannot find -l", low, "\\n\\n")),
        message(('"level": "error", ',), "null", span(c, "true", (text,)), ("error: mismatched\\n  --> a.c:1\\n 1 | let s = \\\"cannot find -l", low, "\\\";\\n  = help: ask ", w)),
        message((), '{"code": null}', span(rs, "true", (text,)), ("error: x\\n  = note: cannot find -l", low)),
        message(('"level": "error", ',), "null", (), ("error: x\\n  = note: see\\n  --> a.c:1\\n    cannot find -l", low, "\\n  = help: none")),
    ]
    out = F.lit(None).cast("string")
    for k, parts in enumerate(forms):
        out = F.when(n % len(forms) == k, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(out)
    return lines(spark, sf_dir).filter(w != "").select("log_id", "line_no", out.alias("line"))


def tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of build tools that each miss something: what a line says comes from its length, the name from its first word."""
    n, w = F.length("line"), F.regexp_extract("line", "[A-Za-z]+", 0)
    low = F.lower(w)
    forms = [
        ("package ", low, " was not found in the pkg-config search path"), ("The System Library `", low, "` required by crate `x` was not found"), ('`"pkg-config" "--libs" "--cflags" "', low, '" "', low, ' >= 3"` did not exit successfully: exit status: 1'),
        ("ld: unable to find library -l", low), ("error: could not find native static library `", low, "`, perhaps an -L flag is missing?"), ("a.c:1:2: fatal error: ", low, "/", low, ".h: No such file or directory"),
        ("fatal error: '", low, ".hpp' file not found"), ("bash: line 3: ", low, ": command not found"), ("zsh:1: command not found: ", low), ("/bin/sh: 1: ", low, ": not found"), ("push: ", low, ": not found"),
        ("Is `", low, "` installed?"), ('failed to find tool "', low, '": No such file'), ("linker `", low, "` not found"), ("could not find lib", low), ("Could NOT find lib", low, " (missing: X)"), ("Unable to find lib", low, ": odd"),
        ("could not find `", low, ".rs`"), ("failed to run custom build command for `", low, " v1`"), ('{"message": "cannot find -l', low, '"}'), ("\x1b[31mld: cannot find -l", low, "\x1b[0m"), ("could not find ", low, " here"), ("make: 12: command not found",),
    ]
    out = F.lit(None).cast("string")
    for k, parts in enumerate(forms):
        out = F.when(n % len(forms) == k, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(out)
    return lines(spark, sf_dir).filter(w != "").select("log_id", "line_no", out.alias("line"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each log's run ended (exit code, time out, memory), its task, and what commands and environment it had."""
    n = F.col("doc_id")
    return load(spark, sf_dir, "documents").select(
        n.alias("log_id"), F.when(n % 5 == 0, 0).otherwise(101).alias("exit_code"), (n % 13 == 1).alias("timed_out"), (n % 7 == 3).alias("oom"),
        F.element_at(F.array(*map(F.lit, ("test", "check", "build"))), (n % 3).cast("int") + 1).alias("task"), F.when(n % 8 == 2, "make test").otherwise("").alias("override"),
        F.when(n % 9 == 6, "nextest").alias("profile_command"), F.when(n % 2 == 0, F.create_map(F.lit("CARGO_BUILD_JOBS"), F.lit("2"))).otherwise(F.create_map().cast("map<string,string>")).alias("env"),
    )


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagnostic for each line that isn't blank; its level and code come from its length."""
    n = F.length("line")
    level = F.when(n % 3 == 0, "error").when(n % 3 == 1, "warning").otherwise("note")
    code = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("E"), (n % 11).cast("string")))
    return lines(spark, sf_dir).filter(F.length(F.trim("line")) > 0).select("log_id", F.col("line_no").alias("pos"), F.col("line").alias("message"), level.alias("level"), code.alias("code"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of each page's url."""
    rest = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/?#]+/?", ""), "[?#].*$", "")
    return load(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("host"), rest.alias("path"), "url")
