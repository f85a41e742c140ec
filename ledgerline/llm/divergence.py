"""How far the sources of a language lie from each other in their choice of words: an audit over all pairs of sources.

Terms are counted per group (language and source). A language's kept terms are cut into vocabulary chunks, and a group's counts of a chunk are
packed into one row. Groups are cut into blocks, and each pair of blocks is a tile of the matrix of pairs. Packed counts are
sent to the tiles of their block, where a task goes through the chunks one after another and adds to the tile's part of the matrix; it holds
one chunk of two blocks at a time. A tile of a large vocabulary is the sum of several tasks, each of which goes through PART chunks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled, scratch

#: Documents of a language that a term must be in; ranks of terms that are told.
MIN_DOCS, TOP = 10, 10
#: Terms of a vocabulary chunk and groups of a block, in expectation; terms that a task counts before it hands them on.
CHUNK, BLOCK, HELD = 4096, 32, 400_000
#: Chunks that one task of a tile goes through.
PART = 16
SHARE = 1_000_000_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms (of all, and of documents) per group, as far as a task has seen them."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            names = [pa.array([v] * len(times), pa.string()) for v in (lang, source)]
            # terms are UTF-8 as the texts are
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(times), pa.binary()), pa.array(list(times.values()), pa.int64()), pa.array([docs[t] for t in times], pa.int64())], names=["lang", "source", "term", "times", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = Counter(text.as_buffer().to_pybytes().translate(_LETTERS).split())
            times.update(found)
            docs.update(found.keys())
        if sum(len(t) for t, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def _plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, times and docs (documents of the group with the term).

    Terms are runs of ASCII letters and characters beyond ASCII; only A to Z are lower-cased. Null text, lang and source count as ''.
    """
    rows = docs.select(_plain(lang_col).alias("lang"), _plain(source_col).alias("source"), _plain(text_col).cast("binary").alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, times long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """p = 1 + floor(SHARE * (count + 2) / (total + 2 * kept)) of columns; decimals make it exact."""
    return (F.expr(f"CAST({count} + 2 AS DECIMAL(20, 0)) * {SHARE} div CAST({total} + 2 * {kept} AS DECIMAL(20, 0))") + 1).cast("long")


def shares(times: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same for arrays: long division by three digits at a time, so that 64 bits hold every step."""
    whole = total + 2 * kept
    out, rest = np.zeros(times.shape, np.int64), times + 2
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of the pairs of each tile over a part of the chunks; rows come by tile, part and chunk, and chunk -1 names the groups of the tile first."""
    tile: tuple | None = None
    chunk, size, rows = -1, 0, []
    state: dict = {}

    def add() -> None:
        """Add the chunk that has been read to the tile's sums."""
        if chunk < 0 or not rows:
            return
        p = []
        for side in (0, 1):
            times = np.zeros((len(state["names"][side]), size), np.int64)
            for name, s, at, n in rows:
                if s == side:
                    times[state["number"][side][name], at] = n
            p.append(np.array([shares(t, total, state["kept"]) for t, total in zip(times, state["totals"][side], strict=True)]).reshape(times.shape))
        for i, own in enumerate(p[0]):
            state["sums"][i] += distances(own, p[1]).sum(1)
        state["seen"] += size

    def done() -> Iterator[pa.RecordBatch]:
        if tile is None:
            return
        add()
        lang, a, b, _ = tile
        names, sums = state["names"], state["sums"]
        if state["kept"]:
            # terms of chunks that no group of the tile has a word of
            zero = [np.array([int(shares(np.zeros(1, np.int64), t, state["kept"])[0]) for t in totals], np.int64) for totals in state["totals"]]
            sums = sums + (state["terms"] - state["seen"]) * distances(zero[0][:, None], zero[1][None, :])
        found = [(x, y, int(sums[i, j])) for i, x in enumerate(names[0]) for j, y in enumerate(names[1]) if x != y and (a < b or x < y)]
        found += [(y, x, v) for x, y, v in found]
        for low in range(0, len(found), 10_000):
            part = found[low : low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.int64())], names=["lang", "source", "item", "value"])

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["lang"], r["a"], r["b"], r["part"])
            if key != tile:
                yield from done()
                tile, chunk, rows = key, -1, []
                state = {"names": ([], []), "totals": ([], []), "number": ({}, {}), "kept": r["kept"], "terms": r["terms"], "seen": 0}
            if r["chunk"] != chunk:
                add()
                chunk, size, rows = r["chunk"], r["size"], []
            if chunk < 0:
                side = r["side"]
                state["number"][side][r["source"]] = len(state["names"][side])
                state["names"][side].append(r["source"])
                state["totals"][side].append(r["total"])
                state["sums"] = np.zeros((len(state["names"][0]), len(state["names"][1])), np.int64)
            else:
                rows.append((r["source"], r["side"], np.array(r["at"], np.int64), np.array(r["times"], np.int64)))
    yield from done()


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: each group's distance to every other source of its language, and the terms it uses more than the language.

    A language keeps the terms that are in min_docs of its documents. Of V kept terms, which come N times in a group, a term that comes count times has
    p = 1 + floor(10^9 * (count + 2) / (N + 2 V)). Two values differ by f = floor((p - q)^2 / (p + q)). Part `pair` sums f over all kept terms (0 if there
    are none) for each other source; part `term` tells f against the language's own p for terms that the group has and p exceeds, the
    first `top` of each group. Ranks go by value, falling, then by item as UTF-8. Null text, lang and source are ''; repeated rows count as often as they
    come; a group without terms takes part with zeros. Other columns aren't read. An empty table gives no rows.
    """
    with scratch() as kept_tables:
        # most terms are rare: they are found by a sum over the term's groups, and go before anything is written
        of_term = Window.partitionBy("lang", "term")
        summed = counts(docs, text_col, lang_col, source_col).withColumn("all_times", F.sum("times").over(of_term)).withColumn("all_docs", F.sum("docs").over(of_term))
        common = Settled(summed.filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "times", "all_times"), "term-counts").df
        by_term = common.groupBy("lang", "term").agg(F.first("all_times").alias("all_times"))
        sizes = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_times").alias("all_total"))
        # a term's place in its chunk, in the order of terms; a chunk has some CHUNK terms, whatever the vocabulary
        placed = by_term.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / CHUNK)).cast("int"))
        # dealt by chunk, as a language's terms would else meet in one task
        placed = placed.repartition("lang", "chunk")
        within = Window.partitionBy("lang", "chunk")
        placed = placed.select("lang", "term", "all_times", "all_total", "kept", "chunk", (F.row_number().over(within.orderBy("term")) - 1).alias("at"), F.count("*").over(within).cast("int").alias("size"))
        terms = Settled(placed, "kept-terms").df
        own = Settled(common.drop("all_times").join(terms, ["lang", "term"]).select("lang", "source", "term", "times", "all_times", "all_total", "kept", "chunk", "at", "size"), "kept-counts")
        totals = own.df.groupBy("lang", "source").agg(F.sum("times").alias("total"))
        named = docs.select(_plain(lang_col).alias("lang"), _plain(source_col).alias("source")).distinct()
        per_lang = named.groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left")
        groups = named.join(totals, ["lang", "source"], "left").join(per_lang, "lang")
        blocks = F.ceil(F.col("groups") / BLOCK).cast("int")
        groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
        groups_made = Settled(groups, "term-groups")
        groups = groups_made.df
        packed = own.df.groupBy("lang", "source", "chunk").agg(F.first("size").alias("size"), F.collect_list("at").alias("at"), F.collect_list("times").alias("times"))
        # chunk -1 heads the rows of a tile's part with its groups and the number of terms in it
        part = F.expr(f"chunk div {PART}").cast("int")
        parts = terms.groupBy("lang", part.alias("part")).agg(F.count("*").alias("terms"))
        heads = groups.join(parts, "lang", "left").na.fill(0, ["part", "terms"])
        heads = heads.select("*", F.lit(-1).alias("chunk"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("times"))
        body = groups.join(packed.withColumn("part", part).withColumn("terms", F.lit(0).cast("long")), ["lang", "source"]).select(*heads.columns)
        # each group to the tiles of its block; in the tile of a block with itself it is on both sides
        first = F.transform(F.sequence(F.col("block"), F.col("blocks") - 1), lambda k: F.struct(F.col("block").alias("a"), k.alias("b"), F.lit(0).alias("side")))
        second = F.transform(F.sequence(F.lit(0), F.col("block")), lambda k: F.struct(k.alias("a"), F.col("block").alias("b"), F.lit(1).alias("side")))
        sent = heads.unionByName(body).withColumn("tile", F.explode(F.concat(first, second)))
        sent = sent.select("lang", "tile.a", "tile.b", "part", "chunk", "size", "kept", "terms", "source", "tile.side", "total", "at", "times")
        tiles = sent.repartition("lang", "a", "b", "part").sortWithinPartitions("lang", "a", "b", "part", "chunk")
        partial = tiles.mapInArrow(_tiles, "lang string, source string, item string, value long")
        pairs = Settled(partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "source-pairs")
        kept_tables += [pairs, own, groups_made]
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.df.withColumn("rank", F.row_number().over(by_group)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    p, q = share("times", "total", "kept"), share("all_times", "all_total", "kept")
    more = own.df.join(groups.select("lang", "source", "total"), ["lang", "source"]).filter("times > 0").withColumn("p", p).withColumn("q", q).filter("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    told = more.select("lang", "source", F.col("term").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= top)
    return ranked.unionByName(told.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


_P = f"1 + {SHARE}::HUGEINT * ({{0}} + 2) // ({{1}} + 2 * v)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS every FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(every) AS every_total FROM k GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, {_P.format("coalesce(n, 0)", "total")} AS p, {_P.format("every", "every_total")} AS q
 FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT * FROM every_pair UNION ALL SELECT * FROM terms),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM w WHERE part = 'pair' OR rank <= {TOP}
"""
