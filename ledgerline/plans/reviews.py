"""What an agent is told of a run and asks about it: deltas against a baseline, searches in its log and diagnostics, notices, and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import normalized_span
from ..operators.matching import bag_sides, latest_before
from ..sources.stores import settled
from ..sources.telemetry import as_of, diagnostics, lines, load, paths, tasks
from .base import DIAGS, LINES, PATHS, TASKS, query

# ---- delta of a run's diagnostics against its baseline ----

_SIDES = f"""{DIAGS}, placed AS (SELECT log_id, pos, level, CASE WHEN log_id % 4 = 0 AND code = '' THEN 'E0' ELSE code END AS code, message,
  CASE length(message) % 6 WHEN 0 THEN 'src/main.rs' WHEN 1 THEN 'core/src/lib.rs' WHEN 2 THEN '/abs/x.rs' WHEN 3 THEN '' WHEN 4 THEN 'src' ELSE 'src/util/a.rs' END AS file FROM diags),
 cur AS (SELECT * FROM placed WHERE pos % 6 <> 1), old AS (SELECT log_id, pos, level, code, message, CASE WHEN pos % 7 = 3 AND log_id % 3 = 1 THEN 'old/' || file ELSE file END AS file FROM placed WHERE pos % 5 <> 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, pos, level, code, message, file and now: a run's diagnostics and those of its baseline, which had others and had some in files since moved."""
    n = F.length("message")
    file = F.when(n % 6 == 0, "src/main.rs").when(n % 6 == 1, "core/src/lib.rs").when(n % 6 == 2, "/abs/x.rs").when(n % 6 == 3, "").when(n % 6 == 4, "src").otherwise("src/util/a.rs")
    d = diagnostics(spark, sf_dir).withColumn("file", file).withColumn("code", F.when((F.col("log_id") % 4 == 0) & (F.col("code") == ""), "E0").otherwise(F.col("code")))
    moved = F.when((F.col("pos") % 7 == 3) & (F.col("log_id") % 3 == 1), F.concat(F.lit("old/"), "file")).otherwise(F.col("file"))
    return d.filter("pos % 6 <> 1").withColumn("now", F.lit(True)).unionByName(d.filter("pos % 5 <> 0").withColumn("file", moved).withColumn("now", F.lit(False)))


def delta_report(both: DataFrame, truncated: DataFrame) -> DataFrame:
    """A row per run: new, fixed and preexisting diagnostics as bags, whether that is approximate and by which causes, and the preexisting by crate.

    both: log_id, pos, level, code, message, file and now (false: of the baseline). truncated: log_id, current and baseline, how many were left out of either
    side. A diagnostic is the same if level, code, file and message are, source positions in the message aside. Causes: either side is truncated
    (then nothing is said to be fixed), an error or warning has no code, or a new one differs from one of the baseline by its file only, while others
    are fixed (it may only have moved). A crate is the first part of a file's path that isn't `src`.
    """
    text = normalized_span(F.col("message"))
    strict, fuzzy = F.sha2(F.concat_ws("\0", "level", "code", "file", text), 256), F.sha2(F.concat_ws("\0", "level", "code", text), 256)
    held = settled(both.select("log_id", "pos", "level", "code", "file", "now", F.unhex(strict).alias("strict"), F.unhex(fuzzy).alias("fuzzy")), "delta-sides")
    sides = settled(bag_sides(held, F.col("now"), ["log_id", "strict"], ["pos"], F.expr("pos div 64")), "delta-bags")
    vague = held.groupBy("log_id").agg(F.bool_or((F.col("code") == "") & F.col("level").isin("error", "warning")).alias("empty_code"))
    moved = sides.filter("side = 'new'").join(held.filter("NOT now").select("log_id", "fuzzy").distinct(), ["log_id", "fuzzy"], "left_semi").select("log_id", F.lit(True).alias("moved")).distinct()
    counts = sides.groupBy("log_id").agg(F.count_if(F.col("side") == "new").alias("n_new"), F.count_if(F.col("side") == "fixed").alias("n_fixed"), F.count_if(F.col("side") == "preexisting").alias("n_preexisting"))
    crate = F.coalesce(F.get(F.filter(F.split("file", "/"), lambda s: (s != "src") & (s != "")), F.lit(0)), F.lit("(unknown)"))
    per_crate = sides.filter("side = 'preexisting'").groupBy("log_id", crate.alias("crate")).count()
    summary = per_crate.groupBy("log_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("crate", F.lit(": "), F.col("count").cast("string")))), ", ").alias("summary"))
    out = vague.join(counts, "log_id").join(truncated, "log_id", "left").join(moved, "log_id", "left").join(summary, "log_id", "left").na.fill({"current": 0, "baseline": 0, "moved": False, "summary": ""})
    causes = {"current_truncated": F.col("current") > 0, "baseline_truncated": F.col("baseline") > 0, "empty_code": F.col("empty_code"), "moved": F.col("moved") & (F.col("n_fixed") > 0)}
    why = F.array_join(F.filter(F.array(*[F.when(v, k) for k, v in causes.items()]), lambda x: x.isNotNull()), ",")
    fixed = F.when((F.col("current") > 0) | (F.col("baseline") > 0), 0).otherwise(F.col("n_fixed"))
    return out.select("log_id", "n_new", fixed.alias("n_fixed"), "n_preexisting", (why != "").alias("approximate"), why.alias("causes"), "summary")


_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(message, '[A-Za-z0-9_./-]+\\.rs:[0-9]+(:[0-9]+)?', '', 'g'), ':[0-9]+:[0-9]+', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH {_SIDES}, c AS (SELECT *, level || '|' || code || '|' || {_KEY} AS fuzzy, row_number() OVER (PARTITION BY log_id, level, code, file, {_KEY} ORDER BY pos) AS nth FROM cur),
 b AS (SELECT *, level || '|' || code || '|' || {_KEY} AS fuzzy, row_number() OVER (PARTITION BY log_id, level, code, file, {_KEY} ORDER BY pos) AS nth FROM old),
 m AS (SELECT coalesce(c.log_id, b.log_id) AS log_id, coalesce(c.file, b.file) AS file, c.fuzzy AS fuzzy, CASE WHEN b.log_id IS NULL THEN 'new' WHEN c.log_id IS NULL THEN 'fixed' ELSE 'preexisting' END AS side
  FROM c FULL JOIN b ON c.log_id = b.log_id AND c.fuzzy = b.fuzzy AND c.file = b.file AND c.nth = b.nth),
 n AS (SELECT log_id, count(*) FILTER (WHERE side = 'new') AS n_new, count(*) FILTER (WHERE side = 'fixed') AS n_fixed, count(*) FILTER (WHERE side = 'preexisting') AS n_preexisting,
  bool_or(side = 'new' AND EXISTS (SELECT 1 FROM b WHERE b.log_id = m.log_id AND b.fuzzy = m.fuzzy)) AS moved FROM m GROUP BY 1),
 v AS (SELECT log_id, bool_or(code = '' AND level IN ('error', 'warning')) AS vague FROM (SELECT * FROM cur UNION ALL SELECT * FROM old) GROUP BY 1),
 k AS (SELECT log_id, CASE WHEN file IN ('', 'src') THEN '(unknown)' WHEN file = 'src/main.rs' THEN 'main.rs' WHEN starts_with(file, '/abs') THEN 'abs' ELSE regexp_extract(regexp_replace(file, '^src/', ''), '^[^/]+') END AS crate, count(*) AS n FROM m WHERE side = 'preexisting' GROUP BY 1, 2),
 s AS (SELECT log_id, string_agg(crate || ': ' || n, ', ' ORDER BY crate || ': ' || n) AS summary FROM k GROUP BY 1),
 t AS (SELECT n.*, vague, coalesce(summary, '') AS summary, n.log_id % 11 = 0 AS cut, n.log_id % 13 = 0 AS old_cut FROM n JOIN v USING (log_id) LEFT JOIN s ON s.log_id = n.log_id),
 w AS (SELECT *, concat_ws(',', CASE WHEN cut THEN 'current_truncated' END, CASE WHEN old_cut THEN 'baseline_truncated' END, CASE WHEN vague THEN 'empty_code' END, CASE WHEN moved AND n_fixed > 0 THEN 'moved' END) AS causes FROM t)
 SELECT log_id, n_new, CASE WHEN cut OR old_cut THEN 0 ELSE n_fixed END AS n_fixed, n_preexisting, causes <> '' AS approximate, causes, summary FROM w""")
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta of each run against its baseline, with the causes that make it approximate and the crates that what was there before is in."""
    n = F.col("doc_id")
    cut = load(spark, sf_dir, "documents").select(n.alias("log_id"), F.when(n % 11 == 0, 2).otherwise(0).alias("current"), F.when(n % 13 == 0, 1).otherwise(0).alias("baseline")).distinct()
    return delta_report(_sides(spark, sf_dir), cut)


# ---- searches ----

#: Lines that a search gives if it isn't told how many, and at most; diagnostics at most.
LINES_DEFAULT, LINES_MOST, DIAGNOSTICS_MOST = 200, 2000, 100


def log_chunks(asked: DataFrame, logs: DataFrame) -> DataFrame:
    """What each search finds, in a row of its own even where that is nothing: lines (of the log's text), offset, next_offset, total, matched, truncated and empty_reason.

    asked: query, log_id, needle (in any case; empty: every line), start, most (0: LINES_DEFAULT; LINES_MOST at most), tail (from the end) and has_log. Lines
    are counted over the whole log. A log that was never kept gives no_log, a needle that nothing holds no_match.
    """
    most = F.when(F.col("most") == 0, LINES_DEFAULT).otherwise(F.least("most", F.lit(LINES_MOST)))
    kept = asked.filter("has_log").withColumn("most", most)
    sizes = logs.groupBy("log_id").agg(F.count("*").alias("raw"))
    found = kept.select("query", "log_id", F.lower("needle").alias("needle"), "start", "most", "tail").join(logs, "log_id").filter((F.col("needle") == "") | F.contains(F.lower("line"), F.col("needle")))
    sums = found.groupBy("query").agg(F.count("*").alias("matched"))
    matched = F.coalesce("matched", F.lit(0))
    first = F.when(F.col("tail"), F.greatest(matched - F.col("most"), F.lit(0))).otherwise(F.least(F.col("start"), matched))
    told = kept.join(sums, "query", "left").join(sizes, "log_id", "left").withColumn("matched", matched).withColumn("offset", first).withColumn("next_offset", F.least(F.col("offset") + F.col("most"), "matched"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("line_no"))
    # the page's bounds are known by then, so only its lines go on
    shown = found.withColumn("place", place).join(told.select("query", "offset", "next_offset"), "query").filter((F.col("place") > F.col("offset")) & (F.col("place") <= F.col("next_offset")))
    text = shown.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))
    raw = F.coalesce("raw", F.lit(0))
    total = F.when(F.col("needle") == "", F.col("matched")).otherwise(raw)
    reason = F.when((F.col("matched") == 0) & (F.col("needle") != ""), "no_match").otherwise("")
    out = told.join(text, "query", "left").select("query", F.coalesce("text", F.lit("")).alias("text"), "offset", "next_offset", total.alias("total"), "matched", (F.col("next_offset") < F.col("matched")).alias("truncated"), reason.alias("empty_reason"))
    none = asked.filter("NOT has_log").select("query", F.lit("").alias("text"), *[F.lit(0).cast("long").alias(c) for c in ("offset", "next_offset", "total", "matched")], F.lit(False).alias("truncated"), F.lit("no_log").alias("empty_reason"))
    return out.unionByName(none)


@query(f"""WITH {LINES}, q AS (SELECT doc_id AS query, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'the' ELSE 'Qzx' END AS needle, doc_id % 4 AS start, CASE doc_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 2000 ELSE doc_id % 5 END AS most, doc_id % 2 = 0 AS tail, doc_id % 10 <> 7 AS has_log FROM documents),
 f AS (SELECT query, line, row_number() OVER (PARTITION BY query ORDER BY line_no) AS place FROM q JOIN lines ON log_id = query WHERE has_log AND (needle = '' OR contains(lower(line), lower(needle)))),
 n AS (SELECT query, count(*) AS matched FROM f GROUP BY 1), r AS (SELECT log_id, count(*) AS raw FROM lines GROUP BY 1),
 o AS (SELECT q.*, coalesce(matched, 0) AS matched, coalesce(raw, 0) AS raw, CASE WHEN tail THEN greatest(coalesce(matched, 0) - most, 0) ELSE least(start, coalesce(matched, 0)) END AS first FROM q LEFT JOIN n ON n.query = q.query LEFT JOIN r ON r.log_id = q.query),
 e AS (SELECT *, least(first + most, matched) AS next FROM o), t AS (SELECT e.query, string_agg(line, chr(10) ORDER BY place) AS text FROM e JOIN f ON f.query = e.query WHERE place > first AND place <= next GROUP BY 1)
 SELECT e.query, CASE WHEN has_log THEN coalesce(text, '') ELSE '' END AS text, CASE WHEN has_log THEN first ELSE 0 END AS "offset", CASE WHEN has_log THEN next ELSE 0 END AS next_offset, CASE WHEN NOT has_log THEN 0 WHEN needle = '' THEN matched ELSE raw END AS total,
  CASE WHEN has_log THEN matched ELSE 0 END AS matched, has_log AND next < matched AS truncated, CASE WHEN NOT has_log THEN 'no_log' WHEN matched = 0 AND needle <> '' THEN 'no_match' ELSE '' END AS empty_reason FROM e LEFT JOIN t ON t.query = e.query""")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search for each log: with a needle or none, from an offset or the end, with honest totals and the reason where nothing is found."""
    n = F.col("doc_id")
    most = F.when(n % 5 == 0, 0).when(n % 5 == 1, 5000).otherwise(n % 5)
    asked = load(spark, sf_dir, "documents").select(n.alias("query"), n.alias("log_id"), F.when(n % 3 == 0, "").when(n % 3 == 1, "the").otherwise("Qzx").alias("needle"), (n % 4).alias("start"), most.alias("most"), (n % 2 == 0).alias("tail"), (n % 10 != 7).alias("has_log"))
    return log_chunks(asked, lines(spark, sf_dir))


def diagnostic_pages(asked: DataFrame, found: DataFrame) -> DataFrame:
    """query, pos, place and total of the diagnostics that each search shows.

    asked: query, log_id, severity (all or empty: any), code and file (a prefix; empty: any), only_new, start and most (held between 1 and DIAGNOSTICS_MOST).
    found: log_id, pos, level, code, file and is_new.
    """
    same = (F.col("severity").isin("", "all") | (F.col("level") == F.col("severity"))) & ((F.col("want") == "") | (F.col("code") == F.col("want"))) & F.startswith("file", F.col("prefix")) & (~F.col("only_new") | F.col("is_new"))
    hits = asked.select("query", "log_id", "severity", F.col("code").alias("want"), F.col("file").alias("prefix"), "only_new", "start", "most").join(found, "log_id").filter(same)
    w = Window.partitionBy("query")
    placed = hits.withColumn("place", F.row_number().over(w.orderBy("pos"))).withColumn("total", F.count("*").over(w))
    most = F.greatest(F.least("most", F.lit(DIAGNOSTICS_MOST)), F.lit(1))
    return placed.filter((F.col("place") > F.col("start")) & (F.col("place") <= F.col("start") + most)).select("query", "pos", "place", "total")


@query(f"""WITH {_SIDES}, q AS (SELECT doc_id AS query, CASE doc_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'all' ELSE 'note' END AS severity, CASE WHEN doc_id % 5 = 0 THEN 'E7' ELSE '' END AS want, CASE doc_id % 3 WHEN 0 THEN 'src/' ELSE '' END AS prefix, doc_id % 6 = 5 AS only_new, doc_id % 2 AS start, CASE doc_id % 7 WHEN 0 THEN 100 WHEN 1 THEN 1 ELSE doc_id % 7 END AS most FROM documents),
 h AS (SELECT query, pos, start, most, row_number() OVER (PARTITION BY query ORDER BY pos) AS place, count(*) OVER (PARTITION BY query) AS total FROM q JOIN cur ON log_id = query
  WHERE (severity = 'all' OR level = severity) AND (want = '' OR code = want) AND starts_with(file, prefix) AND (NOT only_new OR pos % 5 = 0)) SELECT query, pos, place, total FROM h WHERE place > start AND place <= start + most""")
def diagnostic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each run's diagnostics by severity, code, file and newness; how many a page may hold is kept in bounds."""
    n = F.col("doc_id")
    asked = load(spark, sf_dir, "documents").select(
        n.alias("query"), n.alias("log_id"), F.when(n % 4 == 0, "error").when(n % 4 == 1, "warning").when(n % 4 == 2, "all").otherwise("note").alias("severity"), F.when(n % 5 == 0, "E7").otherwise("").alias("code"), F.when(n % 3 == 0, "src/").otherwise("").alias("file"),
        (n % 6 == 5).alias("only_new"), (n % 2).alias("start"), F.when(n % 7 == 0, 1000).when(n % 7 == 1, -3).otherwise(n % 7).alias("most"),
    )
    return diagnostic_pages(asked, _sides(spark, sf_dir).filter("now").withColumn("is_new", F.col("pos") % 5 == 0))


@query(f"""WITH {LINES}, l AS (SELECT log_id, line_no, line, trim(line, ' ' || chr(9) || chr(13)) AS bare, max(line_no) OVER (PARTITION BY log_id) AS n FROM (SELECT log_id, line_no, CASE WHEN length(line) % 9 = 4 THEN ' error: ' || line ELSE line END AS line FROM lines)),
 f AS (SELECT log_id, any_value(n) AS n, min(line_no) FILTER (WHERE contains(lower(line), 'the')) AS hit, min(line_no) FILTER (WHERE starts_with(bare, 'error') OR contains(bare, 'error:') OR starts_with(bare, 'fatal')) AS bad, max(line_no) FILTER (WHERE bare <> '') AS last, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line_no > n - 3) AS tail FROM l GROUP BY 1)
 SELECT f.log_id, f.n AS lines, coalesce(hit, 0) AS line_no, coalesce(left(bare, 300), '') AS first_error, coalesce(tail, '') AS tail FROM f LEFT JOIN l ON l.log_id = f.log_id AND l.line_no = coalesce(bad, last)""")
def log_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each log: its lines, where a needle first stands (0: nowhere), its last three lines, and the line that tells most: the first that speaks of an error, else the last that isn't blank."""
    line = F.when(F.length("line") % 9 == 4, F.concat(F.lit(" error: "), "line")).otherwise(F.col("line"))
    return summaries(lines(spark, sf_dir).withColumn("line", line), "the", 3)


def summaries(logs: DataFrame, needle: str, n: int) -> DataFrame:
    """log_id, lines, line_no, first_error (300 characters at most) and tail (the last n lines); of the ends only n lines a task are shuffled."""
    bare = F.trim(F.col("line"), F.lit(" \t\r"))
    bad = bare.startswith("error") | F.contains(bare, F.lit("error:")) | bare.startswith("fatal")
    at = F.struct("line_no", F.left(bare, F.lit(300)).alias("text"))
    told = logs.groupBy("log_id").agg(F.count("*").alias("lines"), F.min(F.when(F.contains(F.lower("line"), F.lit(needle)), F.col("line_no"))).alias("hit"), F.min(F.when(bad, at)).alias("bad"), F.max(F.when(bare != "", at)).alias("last"))
    ends = logs.withColumn("_back", F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("line_no")))).filter(F.col("_back") <= n)
    tails = ends.groupBy("log_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("tail"))
    return told.join(tails, "log_id", "left").select("log_id", "lines", F.coalesce("hit", F.lit(0)).alias("line_no"), F.coalesce("bad.text", "last.text", F.lit("")).alias("first_error"), F.coalesce("tail", F.lit("")).alias("tail"))


# ---- baselines ----


@query(f"""WITH {TASKS}, f AS (SELECT *, at_us + build_ms * 1000 AS finished, CASE id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'last_success' WHEN 2 THEN 'id' WHEN 3 THEN '' ELSE 'auto' END AS mode, CASE WHEN id % 3 = 0 THEN '' ELSE 's' || (k % 2) END AS scope, CASE WHEN id % 10 = 2 THEN id ELSE id - 1 END AS named FROM tasks)
 SELECT f.id, f.mode, CASE f.mode WHEN 'none' THEN NULL WHEN '' THEN NULL WHEN 'id' THEN (SELECT g.id FROM f g WHERE g.id = f.named AND f.named <> f.id)
  ELSE (SELECT arg_max(g.id, (g.finished, g.id)) FROM f g WHERE g.project = f.project AND g.worktree = f.worktree AND g.event_type = f.event_type AND g.status = 'done' AND g.scope = f.scope AND (g.finished < f.finished OR (g.finished = f.finished AND g.id < f.id)) AND (f.mode = 'auto' OR g.result_kind = 'success')) END AS base FROM f""")
def baseline_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task that each one is compared with, by what it asks for: the last done before it finished, the last success, a task by its id but never itself, or none.

    Candidates finished before it, by id where they finished together, and have its project, worktree, type and scope.
    """
    t = tasks(spark, sf_dir)
    n = F.col("id")
    mode = F.when(n % 5 == 0, "none").when(n % 5 == 1, "last_success").when(n % 5 == 2, "id").when(n % 5 == 3, "").otherwise("auto")
    f = t.withColumn("finished", F.col("at_us") + F.col("build_ms") * 1000).withColumn("mode", mode).withColumn("scope", F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("k") % 2))).withColumn("named", F.when(n % 10 == 2, n).otherwise(n - 1))
    keys, order = ["project", "worktree", "event_type", "scope"], ["finished", "id"]
    done = F.col("status") == "done"
    last = latest_before(f, keys, order, done, n)
    success = latest_before(f, keys, order, done & (F.col("result_kind") == "success"), n)
    seen = f.select("id", "mode", "named", last.alias("last"), success.alias("success"))
    known = t.select(F.col("id").alias("there"))
    named = seen.join(known, (F.col("mode") == "id") & (F.col("named") == F.col("there")) & (F.col("named") != F.col("id")), "left")
    return named.select("id", "mode", F.when(F.col("mode") == "auto", F.col("last")).when(F.col("mode") == "last_success", F.col("success")).when(F.col("mode") == "id", F.col("there")).alias("base"))


# ---- notices ----

#: Notices by what a scan may have to tell, and how grave each is.
PRODUCERS = {"sync_roots": "info", "exclude": "critical", "include": "info", "egress_config": "warning", "egress_pending": "critical", "egress_refused": "critical", "baseline_off": "critical", "scanner": "warning"}


def notices(scans: DataFrame) -> DataFrame:
    """id, category, severity and identity (sorted parts) of what each scan has to tell, one row a category.

    scans: id, roots (the primary one first), exclude, include, egress_config, egress_pending, egress_refused and warnings, arrays of texts. Roots are
    told where there are two or more, without the primary one. Of warnings, each that speaks of a baseline is a notice of its own; the others are one.
    """
    off = lambda w: F.contains(F.lower(w), F.lit("baseline"))
    parts = {"sync_roots": F.when(F.size("roots") > 1, F.slice("roots", 2, F.size("roots")))} | {c: F.col(c) for c in ("exclude", "include", "egress_config", "egress_pending", "egress_refused")}
    row = lambda c, p: F.struct(F.lit(c).alias("category"), F.lit(PRODUCERS[c]).alias("severity"), F.array_join(F.sort_array(p), ",").alias("identity"))
    one = F.filter(F.array(*[F.when(F.size(p) > 0, row(c, p)) for c, p in parts.items()]), lambda x: x.isNotNull())
    each = F.transform(F.filter("warnings", off), lambda w: row("baseline_off", F.array(w)))
    rest = F.filter("warnings", lambda w: ~off(w))
    last = F.when(F.size(rest) > 0, F.array(row("scanner", rest))).otherwise(F.filter(F.array(row("scanner", rest)), lambda x: F.lit(False)))
    return scans.select("id", F.inline(F.concat(one, each, last)))


@query(f"""WITH {TASKS}, s AS (SELECT id, k, CASE WHEN k % 4 = 0 THEN '../a,../b' WHEN k % 4 = 1 THEN '../b' END AS sync_roots, CASE WHEN k % 3 = 0 THEN '*.log' END AS exclude, CASE WHEN k % 5 = 0 THEN 'gen,out' END AS include, CASE WHEN k % 7 = 0 THEN 'http://x' END AS egress_config,
  CASE WHEN k % 6 = 1 THEN event_type || '.org' END AS egress_pending, CASE WHEN k % 8 = 3 THEN 'z.org' END AS egress_refused, CASE WHEN k % 9 = 0 THEN 'Baseline is gone' END AS baseline_off, CASE WHEN k % 9 = 0 THEN 'slow disk' WHEN k % 9 = 1 THEN 'odd link,slow disk' END AS scanner FROM tasks)
 SELECT id, category, CASE WHEN category IN ('sync_roots', 'include') THEN 'info' WHEN category IN ('egress_config', 'scanner') THEN 'warning' ELSE 'critical' END AS severity, identity FROM (UNPIVOT s ON sync_roots, exclude, include, egress_config, egress_pending, egress_refused, baseline_off, scanner INTO NAME category VALUE identity)""")
def notice_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each task's scan has to tell, by category."""
    k = F.col("k")
    none = F.array().cast("array<string>")
    given = lambda cond, *texts: F.when(cond, F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])).otherwise(none)
    scans = tasks(spark, sf_dir).select(
        "id", F.when(k % 4 == 0, F.array(F.lit("."), F.lit("../b"), F.lit("../a"))).when(k % 4 == 1, F.array(F.lit("."), F.lit("../b"))).otherwise(F.array(F.lit("."))).alias("roots"), given(k % 3 == 0, "*.log").alias("exclude"), given(k % 5 == 0, "out", "gen").alias("include"), given(k % 7 == 0, "http://x").alias("egress_config"),
        given(k % 6 == 1, F.concat("event_type", F.lit(".org"))).alias("egress_pending"), given(k % 8 == 3, "z.org").alias("egress_refused"), F.when(k % 9 == 0, F.array(F.lit("slow disk"), F.lit("Baseline is gone"))).when(k % 9 == 1, F.array(F.lit("slow disk"), F.lit("odd link"))).otherwise(none).alias("warnings"),
    )
    return notices(scans)


# ---- approvals ----

#: Hosts that a project may have in its queue.
QUEUE = 8


def taken_up(requests: DataFrame, held: DataFrame, cap: int) -> DataFrame:
    """key, item and taken for each pair that was asked for (requests: key, item, at): whether it has a row, as it had one before (held: key, item) or was given one.

    A pair is new the first time it is asked for. Only new rows use up room, in the order in which they are first asked for, up to `cap` rows a
    key with those held; asking again changes nothing. What is refused is decided anew on each request, but room never comes back.
    """
    first = requests.groupBy("key", "item").agg(F.min("at").alias("at"))
    old = held.select("key", "item").distinct()
    had = old.groupBy("key").agg(F.count("*").alias("had"))
    new = first.join(old, ["key", "item"], "left_anti")
    place = F.row_number().over(Window.partitionBy("key").orderBy("at", "item"))
    given = new.join(had, "key", "left").withColumn("place", place).select("key", "item", (F.col("place") <= cap - F.coalesce("had", F.lit(0))).alias("taken"))
    return given.unionByName(first.join(old, ["key", "item"], "left_semi").select("key", "item", F.lit(True).alias("taken")))


@query(f"""WITH {TASKS}, r AS (SELECT project % 40 AS key, 'h' || (k % 30) AS item, min(struct_pack(a := at_us, i := id)) AS came FROM tasks WHERE event_type <> 'purchase' GROUP BY 1, 2), o AS (SELECT DISTINCT project % 40 AS key, 'h' || (k % 30) AS item FROM tasks WHERE event_type = 'purchase' AND k % 30 < 4),
 h AS (SELECT key, count(*) AS had FROM o GROUP BY 1), n AS (SELECT r.key, r.item, row_number() OVER (PARTITION BY r.key ORDER BY came, r.item) AS place FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.key = r.key AND o.item = r.item)),
 t AS (SELECT n.key, n.item, place <= {QUEUE} - coalesce(had, 0) AS taken FROM n LEFT JOIN h ON h.key = n.key UNION ALL SELECT r.key, r.item, true FROM r WHERE EXISTS (SELECT 1 FROM o WHERE o.key = r.key AND o.item = r.item)),
 d AS (SELECT project % 40 AS key, 'h' || (k % 30) AS item, arg_max(CASE WHEN id % 2 = 0 THEN 'approved' ELSE 'rejected' END, (at_us, id)) AS decision FROM tasks WHERE event_type = 'error' GROUP BY 1, 2)
 SELECT t.key, t.item, taken, CASE WHEN taken THEN coalesce(decision, 'pending') ELSE 'refused' END AS decision FROM t LEFT JOIN d ON d.key = t.key AND d.item = t.item""")
def egress_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that projects ask for: taken up as long as the project's queue has room, with their latest decision, which asking again never changes."""
    t = tasks(spark, sf_dir).select((F.col("project") % 40).alias("key"), F.concat(F.lit("h"), F.col("k") % 30).alias("item"), F.struct("at_us", "id").alias("at"), "event_type", "id", "k")
    pairs = taken_up(t.filter("event_type <> 'purchase'").select("key", "item", "at"), t.filter("event_type = 'purchase' AND k % 30 < 4"), QUEUE)
    decided = t.filter("event_type = 'error'").groupBy("key", "item").agg(F.max_by(F.when(F.col("id") % 2 == 0, "approved").otherwise("rejected"), "at").alias("decision"))
    return pairs.join(decided, ["key", "item"], "left").select("key", "item", "taken", F.when(F.col("taken"), F.coalesce("decision", F.lit("pending"))).otherwise("refused").alias("decision"))


def script_states(decisions: DataFrame) -> DataFrame:
    """key, digest and status after all decisions (key, digest, at, status): approving a script supersedes the one that was approved before it, so each key has one at most."""
    latest = decisions.withColumn("later", F.max(F.when(F.col("status") == "approved", F.col("at"))).over(Window.partitionBy("key"))).groupBy("key", "digest").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"), F.first("later").alias("later"))
    return latest.select("key", "digest", F.when((F.col("status") == "approved") & (F.col("at") < F.col("later")), "superseded").otherwise(F.col("status")).alias("status"))


@query(f"""WITH {TASKS}, d AS (SELECT project AS key, 'd' || (k % 4) AS digest, (at_us, id) AS came, CASE id % 3 WHEN 0 THEN 'rejected' ELSE 'approved' END AS status FROM tasks WHERE event_type IN ('purchase', 'click')),
 l AS (SELECT key, digest, arg_max(status, came) AS status, max(came) AS came FROM d GROUP BY 1, 2), a AS (SELECT key, max(came) AS later FROM d WHERE status = 'approved' GROUP BY 1)
 SELECT l.key, digest, CASE WHEN status = 'approved' AND l.came < later THEN 'superseded' ELSE status END AS status FROM l LEFT JOIN a ON a.key = l.key""")
def script_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each script of a project: the last approval retires the one before."""
    t = tasks(spark, sf_dir).filter("event_type IN ('purchase', 'click')")
    return script_states(t.select(F.col("project").alias("key"), F.concat(F.lit("d"), F.col("k") % 4).alias("digest"), F.struct("at_us", "id").alias("at"), F.when(F.col("id") % 3 == 0, "rejected").otherwise("approved").alias("status")))


# ---- reclaiming ----


def reclaimed(volumes: DataFrame, now: Column, idle: int, all_unused: Column, active: DataFrame) -> DataFrame:
    """Volumes (worktree, used) with a decision: active where a live task has the worktree, else reclaimed if all unused ones go or it lay idle for `idle` seconds. A volume of no worktree is kept."""
    live = active.select("worktree", F.lit(True).alias("_live")).distinct()
    decision = F.when(F.col("worktree").isNull(), "kept").when(F.col("_live"), "skipped_active").when(all_unused, "reclaimed").when(F.col("used") > now - max(idle, 0), "skipped_fresh").otherwise("reclaimed")
    return volumes.join(live, "worktree", "left").withColumn("decision", decision).drop("_live")


@query("""WITH n AS (SELECT max(o_orderdate) AS now FROM orders), o AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS worktree, o_orderdate AS used, o_orderstatus, o_totalprice, unnest([false, true]) AS all_unused FROM orders), l AS (SELECT DISTINCT worktree FROM o WHERE o_orderstatus = 'P')
 SELECT all_unused, CASE WHEN o.worktree IS NULL THEN 'kept' WHEN l.worktree IS NOT NULL THEN 'skipped_active' WHEN all_unused THEN 'reclaimed' WHEN used > now - INTERVAL 180 DAY THEN 'skipped_fresh' ELSE 'reclaimed' END AS decision, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS bytes
 FROM o CROSS JOIN n LEFT JOIN l ON l.worktree = o.worktree GROUP BY 1, 2""")
def reclaim_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is decided about volumes under either policy: all that no live task uses, or those that lay idle."""
    o = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("worktree"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("used"), "o_orderstatus", "o_totalprice")
    both = o.withColumn("all_unused", F.explode(F.array(F.lit(False), F.lit(True))))
    out = reclaimed(both, as_of(o, "used"), 180 * 86_400, F.col("all_unused"), o.filter("o_orderstatus = 'P' AND worktree IS NOT NULL"))
    return out.groupBy("all_unused", "decision").agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).cast("long").alias("bytes"))


# ---- consent and collisions ----


def consent(found: DataFrame, policies: DataFrame, allowed: DataFrame) -> DataFrame:
    """repo, state, n_pending and n_synced for each repository that has roots outside it (found: repo, root).

    policies: repo and policy (auto, list or none; absent counts as none). auto takes all, an empty list none but blocks nothing, a list (allowed: repo,
    dir) blocks the repository while a root lies in no allowed directory, and no policy blocks it until somebody decides. A directory allows what is in it.
    """
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("root", "/"))), lambda n: F.array_join(F.slice(F.split("root", "/"), 1, n), "/"))
    inside = found.select("repo", "root", F.explode(up).alias("dir")).join(allowed.select("repo", "dir"), ["repo", "dir"], "left_semi").select("repo", "root", F.lit(True).alias("_ok")).distinct()
    lists = allowed.select("repo").distinct().withColumn("_listed", F.lit(True))
    rows = found.join(policies, "repo", "left").join(lists, "repo", "left").join(inside, ["repo", "root"], "left")
    policy = F.coalesce("policy", F.lit("none"))
    empty = (policy == "list") & F.col("_listed").isNull()
    pending = (policy == "none") | ((policy == "list") & ~empty & F.col("_ok").isNull())
    sums = rows.groupBy("repo").agg(F.count_if(pending).alias("n_pending"), F.count_if(~empty).alias("n"))
    return sums.select("repo", F.when(F.col("n_pending") > 0, "blocked").otherwise("approved").alias("state"), "n_pending", F.when(F.col("n_pending") > 0, 0).otherwise(F.col("n")).alias("n_synced"))


@query(f"""WITH {PATHS}, f AS (SELECT DISTINCT host AS repo, path AS root FROM paths WHERE path <> ''), h AS (SELECT host AS repo, min(page_id) % 5 AS n FROM paths GROUP BY 1), a AS (SELECT DISTINCT repo, split_part(root, '/', 1) AS dir, n FROM f JOIN h USING (repo) WHERE n = 1 OR (n = 2 AND length(root) % 2 = 0)),
 r AS (SELECT f.repo, f.root, n, EXISTS (SELECT 1 FROM a WHERE a.repo = f.repo AND (f.root = a.dir OR starts_with(f.root, a.dir || '/'))) AS ok, EXISTS (SELECT 1 FROM a WHERE a.repo = f.repo) AS listed FROM f JOIN h ON h.repo = f.repo),
 s AS (SELECT repo, count(*) FILTER (WHERE n = 4 OR (n IN (1, 2) AND listed AND NOT ok)) AS n_pending, count(*) FILTER (WHERE NOT (n = 3 OR (n IN (1, 2) AND NOT listed))) AS n FROM r GROUP BY 1)
 SELECT repo, CASE WHEN n_pending > 0 THEN 'blocked' ELSE 'approved' END AS state, n_pending, CASE WHEN n_pending > 0 THEN 0 ELSE n END AS n_synced FROM s""")
def consent_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each host's roots may be synced, by its policy: take all, an allowed list, an empty one, or none yet."""
    p = paths(spark, sf_dir)
    found = p.filter("path <> ''").select(F.col("host").alias("repo"), F.col("path").alias("root")).distinct()
    way = p.groupBy(F.col("host").alias("repo")).agg((F.min("page_id") % 5).alias("n"))
    policies = way.filter("n <> 4").select("repo", F.when(F.col("n") == 0, "auto").otherwise("list").alias("policy"))
    listed = found.join(way, "repo").filter("n = 1 OR (n = 2 AND length(root) % 2 = 0)").select("repo", F.split_part("root", F.lit("/"), F.lit(1)).alias("dir")).distinct()
    return consent(found, policies, listed)


def collisions(entries: DataFrame) -> DataFrame:
    """path and roots of each path that several roots provide (entries: root, path), which no sync may guess between."""
    return entries.distinct().groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("root")), ",").alias("roots")).filter("n > 1").select("path", "roots")


@query(f"""WITH {PATHS}, e AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN host ELSE 'r' || (page_id % 3) END AS root, split_part(path, '/', 1) || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/x' END AS path FROM paths)
 SELECT path, string_agg(root, ',' ORDER BY root) AS roots FROM e GROUP BY 1 HAVING count(*) > 1""")
def root_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that more than one root would provide: an error, told with the roots."""
    n = F.col("page_id")
    root = F.when(n % 3 == 0, F.col("host")).otherwise(F.concat(F.lit("r"), n % 3))
    return collisions(paths(spark, sf_dir).select(root.alias("root"), F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.when(n % 2 == 0, "").otherwise("/x")).alias("path")))
