"""Operators on logs (log_id, line_no, line): verdicts, progress, tests and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diagnostics
from ..functions.classify import VERDICTS, environment_at_fault, marks, rule

#: Lines from a log's end that the classifier looks at.
TAIL = 200
#: Names of failed tests that a summary lists.
LISTED = 20
_IN_ORDER = "OVER (PARTITION BY log_id ORDER BY line_no)"


def classified(logs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """log_id, the rule that each run meets first, kind and attribution, its errors and warnings, and whether its last TAIL lines tell of a broken environment.

    Diagnostics and test results are of the whole log; only marks in raw text are looked for in its end alone. `runs` (log_id, exit_code, timed_out,
    oom, tests: whether its test results may be read) says how each ended; without it, all failed with code 101. A log's end is told by its greatest line
    number. No line's text is shuffled and no log sorted: logs are read once, and counts and the last line of each mark are added up where the lines lie. Runs
    without a log count as those with an empty one.
    """
    d = diagnostics.scraped(F.col("line"))
    failed = F.regexp_extract(diagnostics.bare(F.col("line")), r"^test result:\s*\w+\.\s*[0-9]+ passed; ([0-9]+) failed", 1).try_cast("long")
    found = marks(F.col("line"))
    said = F.when(F.col("line").startswith("test result:") | F.contains("line", F.lit("\x1b")), failed)
    seen = logs.select("log_id", "line_no", d.alias("d"), said.alias("failed"), *[F.when(c, F.col("line_no")).alias(k) for k, c in found.items()])
    at_fault = environment_at_fault(F.col("d.file"), F.col("d.message"))
    counts = seen.groupBy("log_id").agg(
        F.count_if(F.col("d.level") == "error").alias("errors"), F.count_if((F.col("d.level") == "error") & at_fault).alias("env_errors"), F.count_if(F.col("d.level") == "warning").alias("warnings"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"), F.max("line_no").alias("n"), *[F.max(k).alias(k) for k in found],
    )
    # a mark is in a log's end if the last line that has it is
    facts = counts.withColumns({k: F.coalesce(F.col(k) > F.col("n") - TAIL, F.lit(False)) for k in found}).drop("n")
    if runs is None:
        facts = facts.withColumns({"exit_code": F.lit(101), "timed_out": F.lit(False), "oom": F.lit(False), "tests": F.lit(True)})
    else:
        facts = runs.join(facts, "log_id", "left")
    facts = facts.na.fill(0, ["errors", "env_errors", "warnings", "failed"]).na.fill(False, list(found))
    environmental = F.col("env") | (F.col("weak") & F.col("lack"))
    first = rule(F.col("exit_code"), F.col("timed_out"), F.col("errors"), F.col("env_errors"), F.when(F.col("tests"), F.col("failed")).otherwise(0), F.col("oom"), environmental)
    verdict = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, v in VERDICTS.items() for x in (name, v[k])]), F.col("rule"))
    return facts.withColumn("rule", first).select("log_id", "rule", verdict(0).alias("kind"), verdict(1).alias("attribution"), "errors", "warnings", environmental.alias("environmental"))


def progress(logs: DataFrame) -> DataFrame:
    """log_id, units seen and the current one: lines that compile or check count, fresh ones don't."""
    unit = F.regexp_extract("line", r"^\s*(?:Compiling|Checking) (\S+) v", 1)
    return logs.withColumn("unit", unit).filter("unit <> ''").groupBy("log_id").agg(F.count("*").alias("units"), F.max_by("unit", "line_no").alias("current"))


def summed_tests(logs: DataFrame) -> DataFrame:
    """log_id, passed, failed and ignored tests over all binaries, and the first LISTED names of failures with their binaries.

    A binary's name holds for the lines after it. A block of names begins after `failures:` and ends at a line that isn't indented by four.
    """
    number = lambda what: F.coalesce(F.regexp_extract("line", rf"([0-9]+) {what}", 1).try_cast("long"), F.lit(0))
    sums = logs.filter(F.col("line").startswith("test result:")).groupBy("log_id").agg(F.sum(number("passed")).alias("passed"), F.sum(number("failed")).alias("failed"), F.sum(number("ignored")).alias("ignored"), F.count("*").alias("binaries"))
    binary = F.nullif(F.regexp_extract("line", r"^\s*Running (\S+)", 1), F.lit(""))
    marked = logs.withColumn("_b", binary).withColumn("binary", F.expr(f"last(_b, true) {_IN_ORDER}"))
    marked = marked.withColumn("_m", F.when(F.col("line") == "failures:", 1).when(~F.col("line").rlike(r"^    \S"), 0)).withColumn("inside", F.expr(f"last(_m, true) {_IN_ORDER}"))
    names = marked.filter("_m IS NULL AND inside = 1").select("log_id", "line_no", F.concat_ws("::", F.regexp_extract("binary", r"([^/]+?)(?:\.rs)?$", 1), F.trim("line")).alias("name"))
    first = F.collect_list(F.when(F.col("n") <= LISTED, F.struct("n", "name")))
    listed = names.withColumn("n", F.expr(f"row_number() {_IN_ORDER}")).groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(first), lambda x: x["name"]), ",").alias("names"), (F.max("n") > LISTED).alias("truncated"))
    return sums.join(listed, "log_id", "left").na.fill({"names": "", "truncated": False})


def scraped(logs: DataFrame) -> DataFrame:
    """log_id, line_no and what lines of the form file:line[:column]: level: message tell: file, line, column (0: none), level and message."""
    found = logs.select("log_id", "line_no", diagnostics.scraped(F.col("line")).alias("d")).filter("d IS NOT NULL")
    return found.select("log_id", "line_no", *[F.col(f"d.{c}") for c in ("file", "line", "column", "level", "message")])


def compiler_messages(logs: DataFrame) -> DataFrame:
    """log_id, line_no, the diagnostic of each JSON message of a compiler, and whether it is the environment's fault."""
    found = logs.select("log_id", "line_no", diagnostics.compiler_message(F.col("line")).alias("d")).filter("d IS NOT NULL")
    fault = environment_at_fault(F.col("d.file"), diagnostics.evidence(F.col("d.message"), F.col("d.rendered")))
    return found.select("log_id", "line_no", "d.*", fault.alias("environmental"))
