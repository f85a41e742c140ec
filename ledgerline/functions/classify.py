"""The ordered classifier of failed builds and the rules by which missing dependencies are read out of logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .diagnostics import bare
from .messages import CUES, findings, names_dependency

# Phrases that tell a broken environment, and those that need a second phrase beside them.
ENVIRONMENT = [
    "linker `cc` not found", "linker `link.exe` not found", "cannot find -l", "is not installed", "no such subcommand", "command not found",
    "could not execute process", "failed to run custom build command", "error: could not find `cargo.toml`", "permission denied (os error 13)",
    "unable to get packages from source", "failed to authenticate", "network failure", "failed to download",
]
ENVIRONMENT_WEAK = ["the `", "toolchain", "pkg-config", "protoc", "openssl"]
ABSENCE = ["not found", "not installed", "no such file"]


def any_of(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def environment_at_fault(file: Column, text: Column) -> Column:
    """Whether a diagnostic is the environment's fault: its evidence names a header or a library that wasn't found. One of a Rust source never is."""
    return ~file.endswith(".rs") & names_dependency(text)


# What the last lines of a log may hold, by what it tells.
MARKS = {"killed": "(signal: 9, SIGKILL: kill)", "uncompiled": "error: could not compile", "segv": "(signal: 11, SIGSEGV", "abort": "(signal: 6, SIGABRT"}
FULL = "no space left on device"


def marks(line: Column) -> dict[str, Column]:
    """Whether a line holds each thing that the rules look for at a log's end."""
    low = F.lower(line)
    return {k: F.contains(line, F.lit(v)) for k, v in MARKS.items()} | {"full": F.contains(low, F.lit(FULL)), "env": any_of(low, ENVIRONMENT), "weak": any_of(low, ENVIRONMENT_WEAK), "lack": any_of(low, ABSENCE)}


def rule(exit_code: Column, timed_out: Column, errors: Column, env_errors: Column, tests_failed: Column, oom: Column, environmental: Column) -> Column:
    """The first rule that holds, of a run's facts, with the marks of its last lines as columns."""
    crash = F.col("uncompiled") & (F.col("segv") | F.col("abort"))
    return (
        F.when((exit_code == 0) & ~timed_out, "success").when(timed_out, "timeout")
        .when((errors > 0) & (env_errors == errors), "env_diagnostics").when(errors > 0, "compile_error").when(tests_failed > 0, "test_failed")
        .when(oom, "oom_killed").when(F.col("killed"), "sigkill_suspected_oom").when(crash, "rustc_crash")
        .when(F.col("full"), "disk_full").when(environmental, "env_markers_raw").otherwise("unknown")
    )


#: Rule, and what it makes of a run: kind of result, and whom it is put down to.
VERDICTS = {
    "success": ("success", "none"), "timeout": ("timeout", "infra"), "env_diagnostics": ("env_error", "project_config"), "compile_error": ("compile_error", "code"),
    "test_failed": ("compile_error", "code"), "oom_killed": ("env_error", "resource"), "sigkill_suspected_oom": ("env_error", "resource"), "rustc_crash": ("infra_error", "infra"),
    "disk_full": ("infra_error", "infra"), "env_markers_raw": ("env_error", "project_config"), "unknown": ("env_error", "unknown"),
}
#: What a retry changes in the environment, by rule; only what memory ran out of is tried again, with fewer jobs.
REMEDIES = {"oom_killed": ("CARGO_BUILD_JOBS", "2"), "sigkill_suspected_oom": ("CARGO_BUILD_JOBS", "2")}


def parses_tests(task: Column, override: Column, profile_command: Column) -> Column:
    """Whether a run's log may be read for test results: only that of a test whose command nobody has changed."""
    return (task == "test") & (override == "") & profile_command.isNull()


def remedy(rule_: Column, env: Column) -> Column:
    """The environment for a retry, or null where the rule allows none or it would change nothing."""
    table = F.create_map(*[F.lit(x) for name, (key, value) in REMEDIES.items() for x in (name, f"{key}={value}")])
    key, value = F.split_part(F.try_element_at(table, rule_), F.lit("="), F.lit(1)), F.split_part(F.try_element_at(table, rule_), F.lit("="), F.lit(2))
    changed = F.map_concat(F.map_filter(env, lambda k, _: k != key), F.create_map(key, value))
    return F.when(rule_.isin(*REMEDIES) & ~F.try_element_at(env, key).eqNullSafe(value), changed)


# Packages that hold a library, by its pkg-config module, its linker name or its header.
PACKAGES = {
    "openssl": "libssl-dev", "ssl": "libssl-dev", "crypto": "libssl-dev", "z": "zlib1g-dev", "zlib": "zlib1g-dev", "zlib1g": "zlib1g-dev", "alsa": "libasound2-dev",
    "asound": "libasound2-dev", "dbus-1": "libdbus-1-dev", "dbus": "libdbus-1-dev", "udev": "libudev-dev", "systemd": "libsystemd-dev", "curl": "libcurl4-openssl-dev",
    "pq": "libpq-dev", "postgresql": "libpq-dev", "mysqlclient": "default-libmysqlclient-dev", "sqlite3": "libsqlite3-dev", "ssh2": "libssh2-1-dev", "xml2": "libxml2-dev",
    "libxml": "libxml2-dev", "ffi": "libffi-dev", "clang": "libclang-dev", "libclang": "libclang-dev", "glib-2.0": "libglib2.0-dev", "freetype2": "libfreetype6-dev",
    "freetype": "libfreetype6-dev", "fontconfig": "libfontconfig1-dev", "x11": "libx11-dev", "xcb": "libxcb1-dev", "gtk+-3.0": "libgtk-3-dev", "gtk-3.0": "libgtk-3-dev",
    "protobuf": "libprotobuf-dev", "stdc++": "build-essential", "python": "python3-dev", "python3": "python3-dev",
}
# Packages that hold a program.
PROGRAMS = {
    "protoc": "protobuf-compiler", "cmake": "cmake", "pkg-config": "pkg-config", "pkgconf": "pkg-config", "cc": "build-essential", "gcc": "build-essential",
    "g++": "build-essential", "ld": "build-essential", "make": "make", "ninja": "ninja-build", "nasm": "nasm", "yasm": "yasm", "perl": "perl", "python": "python-is-python3",
    "python3": "python3", "go": "golang", "git": "git", "curl": "curl", "clang": "clang", "autoconf": "autoconf", "automake": "automake", "libtool": "libtool-bin",
    "unzip": "unzip", "node": "nodejs",
}
# Endings of files, which prose may say couldn't be found though no package is missing.
SOURCES = [".rs", ".toml", ".lock", ".json", ".yaml", ".yml", ".md", ".txt", ".cfg", ".ini", ".c", ".cc", ".cpp", ".py", ".sh", ".pc", ".cmake", ".m4", ".mk"]
#: Findings that a log reports, and characters of a name.
MOST, LONGEST = 12, 64


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def conventional(stem: Column) -> Column:
    """The package that Debian's convention gives a library: lib<name>-dev, with a version's hyphen left out; null if no name can be read."""
    bare = F.regexp_replace(stem, "^lib", "")
    joined = F.regexp_replace(bare, "-([0-9][^-]*)$", "$1")
    return F.when(bare.rlike("^[A-Za-z0-9_.+-]+$"), F.concat(F.lit("lib"), joined, F.lit("-dev")))


def package_of(kind: Column, name: Column) -> tuple[Column, Column]:
    """The package that holds what is missing, by a table or else by convention (null: nothing is known), and whether it is by the table."""
    low = F.lower(F.trim(name))
    libraries = _table(PACKAGES)
    # a header is known by its folder better than by its own name
    folder = F.regexp_extract(low, "([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract(low, "([^/]*)$", 1), r"\.h(pp)?$", "")
    header = F.coalesce(F.try_element_at(libraries, folder), F.try_element_at(libraries, stem))
    library = F.coalesce(F.try_element_at(libraries, low), F.try_element_at(libraries, F.regexp_replace(low, "^lib", "")))
    known = F.when(kind == "program", F.try_element_at(_table(PROGRAMS), low)).when(kind == "header", header).when(kind != "build-script", library)
    guess = F.when(kind == "header", conventional(F.when(folder != "", folder).otherwise(stem))).when(kind.isin("library", "pkg-config"), conventional(low))
    return F.coalesce(known, guess), known.isNotNull()


def told(lines: DataFrame) -> DataFrame:
    """log_id, line_no, name, kind and weight of all that lines (log_id, line_no, line) say is missing; kind `absent` is pkg-config itself.

    Lines of JSON say nothing. Names found in prose count only if a program, a known package or a lib prefix vouches for them.
    """
    # one search tells whether a line may say anything at all, as most don't
    may = F.col("line").rlike("|".join(CUES)) & ~F.ltrim("line").startswith("{")
    said = lines.filter(may).select("log_id", "line_no", F.rtrim(bare(F.col("line"))).alias("line"))
    found = said.select("log_id", "line_no", F.inline(findings(F.col("line"))))
    found = found.withColumn("name", F.regexp_replace(F.trim("name"), "^[`'\",.]+|[`'\",.]+$", ""))
    low = F.lower("name")
    found = found.withColumn("name", F.when((F.col("kind") == "prose") & (low == "pkgconfig"), "pkg-config").otherwise(F.col("name")))
    file = low.rlike("(?:" + "|".join(re.escape(s) for s in SOURCES) + ")$") | low.isin("library", "libraries", "lib")
    vouched = F.when(F.try_element_at(_table(PROGRAMS), low).isNotNull(), "program").when(~file & (F.try_element_at(_table(PACKAGES), low).isNotNull() | low.startswith("lib")), "pkg-config")
    return found.withColumn("kind", F.when(F.col("kind") != "prose", F.col("kind")).otherwise(vouched)).filter(f"kind is not null AND name <> '' AND length(name) <= {LONGEST}")


def missing_dependencies(lines: DataFrame, most: int = MOST) -> DataFrame:
    """log_id, name, kind, package, certain and place of what each log (log_id, line_no, line) says is missing, best evidence first.

    A name is told once per class of kinds, by its best evidence, then by the telling whose package is known, then the first. Where
    pkg-config itself is missing, what its probes couldn't find is no evidence, and pkg-config comes first. All findings of a log are ranked
    before the first `most` are told, so a late but better one is never lost to a collector that is full.
    """
    found, low = told(lines), F.lower("name")
    package, certain = package_of(F.col("kind"), F.col("name"))
    found = found.withColumn("package", package).withColumn("certain", certain).withColumn("class", F.when(F.col("kind").isin("library", "pkg-config", "header"), "library").otherwise(F.col("kind")))
    use = F.col("certain").cast("int") + F.col("package").isNotNull().cast("int")
    # findings are few beside lines; dealt by log once, they are grouped and ranked where they lie
    best = F.max_by(F.struct("name", "kind", "package", "certain", "weight"), F.struct("weight", use, -F.col("line_no")))
    best_of = found.repartition("log_id").groupBy("log_id", "class", low.alias("low")).agg(best.alias("t"), F.min("line_no").cast("long").alias("first")).select("log_id", "class", "low", "first", "t.*")
    tool = F.col("class") == "absent"
    best_of = best_of.withColumn("lacks", F.max(tool).over(Window.partitionBy("log_id"))).withColumn("best", F.max(F.when(~tool, F.col("weight"))).over(Window.partitionBy("log_id", "low")))
    # of one name in several classes, only the best evidence stays; equals are facts of their own
    kept = best_of.filter(tool | ((F.col("weight") == F.col("best")) & ~(F.col("lacks") & ((F.col("kind") == "pkg-config") | (F.col("low") == "pkg-config")))))
    pick = lambda c, value: F.when(tool, F.lit(value)).otherwise(F.col(c)).alias(c)
    kept = kept.select("log_id", "name", pick("kind", "program"), pick("package", "pkg-config"), pick("certain", True), "weight", pick("first", 0))
    place = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("weight"), "first", "name"))
    return kept.withColumn("place", place).filter(F.col("place") <= most).select("log_id", "name", "kind", "package", "certain", "place")
