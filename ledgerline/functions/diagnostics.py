"""Diagnostics out of logs: lines of text, a compiler's JSON messages, and what of a diagnostic is evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import plain_text

# The form of a diagnostic in text, and the levels of messages that say nothing of their own.
DIAGNOSTIC = r"^\s*([^\s:][^:]*):([0-9]+)(?::([0-9]+))?:\s*(error|warning|fatal error)\b:?\s*(.*)$"
QUIET = ["note", "help", "failure-note"]

#: What of a compiler's message is read.
MESSAGE = """reason STRING, message STRUCT<level: STRING, code: STRUCT<code: STRING>, message: STRING, rendered: STRING,
 spans: ARRAY<STRUCT<is_primary: BOOLEAN, file_name: STRING, line_start: BIGINT, column_start: BIGINT>>>"""


def bare(line: Column) -> Column:
    """A line without escape sequences; few lines have any."""
    return F.when(F.contains(line, F.lit("\x1b")), plain_text(line)).otherwise(line)


def scraped(line: Column) -> Column:
    """level, code, message, file, line, column (0: none) and rendered of a line file:line[:column]: level: message; null of any other."""
    # bound as variables, so that escapes are taken out and the form is read once a line, not once for each of its parts; a file holds no colon, nor do numbers and level
    once = lambda x, of: F.get(F.transform(F.array(x), of), F.lit(0))
    read = lambda t: F.when(t.rlike(DIAGNOSTIC), F.struct(F.split(F.regexp_replace(t, DIAGNOSTIC + r"[\s\S]*", "$1:$2:$3:$4:$5"), ":", 5).alias("p"), F.trim(t).alias("rendered")))
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))

    def told(x: Column) -> Column:
        part = lambda k: F.get(x["p"], F.lit(k - 1))
        level = F.when(part(4) == "warning", "warning").otherwise("error")
        found = F.struct(level.alias("level"), F.lit("").alias("code"), F.trim(part(5)).alias("message"), part(1).alias("file"), number(part(2)).alias("line"), number(part(3)).alias("column"), x["rendered"].alias("rendered"))
        return F.when(x.isNotNull(), found)

    # most lines have none of the words
    may = F.contains(line, F.lit("error")) | F.contains(line, F.lit("warning"))
    return F.when(may, once(once(bare(line), read), told))


def compiler_message(line: Column) -> Column:
    """The same of a line that is a compiler's JSON message; null of other lines, of malformed ones and of messages that say nothing of their own.

    The place is the first primary span's, else the first span's. A message without level is an error.
    """
    said = F.when(F.ltrim(line).startswith("{"), F.from_json(F.trim(line), MESSAGE, {"mode": "PERMISSIVE"}))
    m = said["message"]
    level = F.coalesce(m["level"], F.lit("error"))
    span = F.coalesce(F.get(F.filter(m["spans"], lambda s: s["is_primary"]), F.lit(0)), F.get(m["spans"], F.lit(0)))
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    found = F.struct(
        level.alias("level"), text(m["code"]["code"]).alias("code"), text(m["message"]).alias("message"), text(span["file_name"]).alias("file"), number(span["line_start"]).alias("line"), number(span["column_start"]).alias("column"), plain_text(text(m["rendered"])).alias("rendered")
    )
    return F.when((said["reason"] == "compiler-message") & m.isNotNull() & ~level.isin(QUIET), found)


def evidence(message: Column, rendered: Column) -> Column:
    """What of a diagnostic may tell whose fault it is: its message and its notes and helps, never the source that it quotes.

    A note goes on over indented lines until another annotation, a place (-->) or a line that isn't indented.
    """
    lines = F.split(rendered, "\n")
    bare_ = lambda x: F.ltrim(x)
    opens = lambda x: bare_(x).startswith("= note:") | bare_(x).startswith("= help:")
    ends = lambda x: bare_(x).startswith("-->") | bare_(x).startswith("=") | ~x.rlike(r"^\s")
    start = F.struct(F.lit(False).alias("inside"), F.array(message).alias("kept"))

    def step(held: Column, x: Column) -> Column:
        inside = opens(x) | (held["inside"] & ~ends(x))
        return F.struct(inside.alias("inside"), F.when(inside, F.array_append(held["kept"], bare_(x))).otherwise(held["kept"]).alias("kept"))

    folded = F.aggregate(lines, start, step, lambda held: F.array_join(held["kept"], "\n"))
    # a diagnostic without annotations is its message
    return F.when(F.contains(rendered, F.lit("= ")), folded).otherwise(message)
