"""Removal of lines that spread over many sites.

A HyperLogLog sketch of sites is built for each line's hash; partial sketches merge by aggregation. The estimate decides where it
is far from the threshold. Lines whose estimate is near it get an exact count of their sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, Settled, free_name, scratch

#: A line on so many sites, or more, is boilerplate.
MIN_SITES = 8
#: Estimates within this share of the threshold are counted exactly; the sketches' standard error at LG_K is 1.6 %.
NEAR, LG_K = 0.3, 12


def _hashes(line: Column) -> list[Column]:
    """128 bits of a line without the white space around it."""
    bare = F.trim(line, F.lit(SPACE))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("line"), bare).alias("h2")]


def exploded(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, t1 and t2 (hash of the text), site, pos, h1 and h2 for each line with a word; null sites count as the empty name."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )
    return rows.filter(F.col("line").rlike(WORD)).select("id", "t1", "t2", "site", "pos", *_hashes(F.col("line")))


#: Parts over which the occurrences of a line are dealt in a join, as spread lines are the commonest of all.
SALTS = 16


def occurrences(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Those of `lines` whose hash is among `found` (h1, h2); each found line is there once for every part, and its occurrences are dealt over them by their text."""
    dealt = found.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod(F.xxhash64("t1", "t2"), F.lit(SALTS)).cast("int")).join(dealt, ["h1", "h2", "salt"], "left_semi").drop("salt")


def spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1 and h2 of the lines that are on at least min_sites sites."""
    merged = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch"))
    # a line that occurs less often than min_sites is on fewer sites; its sketch needn't be asked
    asked = Settled(merged.filter(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites").df
    near = asked.filter(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR)))
    exact = occurrences(lines, near.select("h1", "h2")).groupBy("h1", "h2", "site").count().groupBy("h1", "h2").count().filter(F.col("count") >= min_sites)
    return asked.filter(F.col("sites") > min_sites * (1 + NEAR)).select("h1", "h2").unionAll(exact.select("h1", "h2"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of `docs` with their spread lines gone, and two more columns: n_lines (lines with a word) and n_removed.

    Lines are parted by \\n and compared without white space around them; every occurrence of a spread line goes. Lines without a
    word stay and aren't counted. A null text stays null with 0 lines. Rows that repeat are treated alike. All columns are
    kept; n_lines and n_removed replace columns of those names. An empty table gives no rows.
    """
    lines = Settled(exploded(docs, id_col, text_col, site_col), "lines").df
    with scratch() as kept:
        kept.append(Settled(spread(lines, min_sites), "spread-lines"))
    found = kept[0].df
    own = {n: free_name(docs, f"_{n}") for n in ("id", "t1", "t2", "gone", "k1", "k2")}
    marks = occurrences(lines, found).groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    marks = marks.select(*[F.col(n).alias(own[n]) for n in ("id", "t1", "t2", "gone")])
    text, gone = F.col(text_col).cast("string"), F.col(own["gone"])
    own_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in own_columns], F.xxhash64(text).alias(own["k1"]), F.xxhash64(F.lit("text"), text).alias(own["k2"]))
    joined = keyed.join(marks, F.col(id_col).eqNullSafe(F.col(own["id"])) & (F.col(own["k1"]) == F.col(own["t1"])) & (F.col(own["k2"]) == F.col(own["t2"])), "left")
    parts = F.split(text, "\n")
    # a one-entry array binds the lines, so that the text is split once; array_except hashes, so a text of many lines takes no longer for each
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone)
    rest = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n")), F.lit(0))
    clean = F.when(gone.isNull(), text).otherwise(rest)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: x.rlike(WORD))))
    out = [clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in own_columns]
    return joined.select(*out, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text FROM documents),
l AS (SELECT r, doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
s AS (SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
m AS (SELECT k.*, s.bare IS NOT NULL AS gone FROM k LEFT JOIN s ON k.bare = s.bare),
a AS (SELECT r, count(*) FILTER (WHERE bare <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest FROM m GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS text_sha256
FROM d LEFT JOIN a ON d.r = a.r
"""
