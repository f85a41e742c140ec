"""Personal data in texts: fixed formats, and what bootstrapped contexts reveal beyond them. DataFrame functions only.

Spans of fixed formats (email, ip, card, phone) are the seeds. What stands around a seed makes lexical patterns: one or two words on
either side, or what is glued to its front. Looser shapes give candidates: numbers in groups, addresses with (at), addresses of
hexadecimal groups. Patterns and instances (seed or candidate values) form a graph that is scored in rounds: a pattern counts once enough
believed instances stand in it, and is worth the share of its occurrences in the corpus that are believed; an instance is worth what
its patterns make of it together. Candidates that come to be believed are instances like the seeds in the next round: their other
contexts become patterns, which reveal further candidates. Candidates believed in the end become spans of their kind.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, Settled

KINDS = ("email", "ip", "card", "phone")
#: The fixed formats, written so that no run of characters is tried from each of its places: a match starts where the run does, or where the match before it ended.
FORMATS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Looser shapes, and which kinds each may be.
LOOSE = r"(?<![^\s(,;:=\"'<\[])(?:[A-Za-z0-9._%+-]++(?:\(at\)|\[at\]|@)[A-Za-z0-9.-]++|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|[(]?[0-9][0-9().\x20-]{5,30}[0-9])(?![0-9A-Za-z])"
MARK, SPARE = "\x01", "\x02"
#: A pattern counts if so many different believed values stand in it, and if it is worth so much at least.
MIN_SEEDS, MIN_SCORE = 4, 0.1
#: The share by which beliefs must grow for another round, and the belief from which a value counts as an identifier.
GAIN, BELIEVED = 1e-4, 0.9
#: Characters beside a span that patterns are made of, and the longest pattern.
CONTEXT, LONGEST = 40, 60
#: Patterns up to which they are broadcast to the texts that are searched for them, at some 100 bytes each; beyond that, the two are joined by a shuffle.
BROADCAST_PATTERNS = 200_000
#: Matches of a text whose places are added up together.
CHUNK = 64
_WS = r"[\x20\x09-\x0D]"
#: What may be glued to the front of an identifier, and what keeps it apart from words where both are counted.
GLUED, FRONT = r"[^\x20\x09-\x0D0-9@]{1,20}[:=#]", "\x03"


def _pieces(text: Column, pattern: str) -> Column:
    """What stands between and in the matches, by turns: gap, match, gap, ..., gap."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def _starts(pieces: Column) -> Column:
    """Where each piece starts, in code points.

    Appending to an array copies it, so sums are made within chunks of pieces, then over chunks; a text of many matches costs little more than one of few.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
    firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(CHUNK))
    # each chunk: its length, and where its pieces start in it
    chunks = F.transform(firsts, lambda k: F.aggregate(F.transform(F.slice(pieces, k, CHUNK), F.length), zero, step))

    def shifted(held: Column) -> Column:
        bases = F.aggregate(F.transform(held, lambda c: c["at"]), zero, step)["starts"]
        return F.flatten(F.zip_with(held, bases, lambda c, base: F.transform(c["starts"], lambda at: at + base)))

    return F.get(F.transform(F.array(chunks), shifted), F.lit(0))


def _found(text: Column, pattern: str) -> Column:
    """An array of (start, end, value, left, right) for a pattern's matches; left and right are the gaps' ends beside the match."""
    pieces = _pieces(text, pattern)

    def of(held: Column) -> Column:
        p, s = held["p"], held["s"]
        n = F.size(p)
        at = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)), F.lit(2))
        one = lambda k: F.struct(
            F.get(s, k).alias("start"), (F.get(s, k) + F.length(F.get(p, k))).alias("end"), F.get(p, k).alias("value"),
            F.right(F.get(p, k - 1), F.lit(CONTEXT)).alias("left"), F.left(F.get(p, k + 1), F.lit(CONTEXT)).alias("right"),
        )
        return F.when(n >= 3, F.transform(at, one))

    # a one-entry array binds the pieces, so that they are made once
    bound = F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), _starts(p).alias("s")))
    return F.coalesce(F.get(F.transform(bound, of), F.lit(0)), F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn test: every second from the right doubled, digits of that summed, all divisible by ten."""
    d = F.transform(F.split(F.reverse(_digits(value)), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    worth = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & _luhn(value)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


#: A text without these can't hold the format, which spares most texts the search.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a key of the row), doc_id, a column of spans per kind, and `loose`, what has a looser shape."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK, SPARE)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    none = F.array().cast(_SPAN)
    spans = []
    for kind in KINDS:
        found = F.filter(_found(F.col("text"), FORMATS[kind]), _checked(kind))
        able = F.contains("text", F.lit(_NEEDS[kind])) if _NEEDS[kind] else F.col("text").rlike("[0-9](?:[ -]?[0-9]){12}")
        spans.append(F.when(able, found).otherwise(none).alias(kind))
    rows = rows.select("row", "doc_id", "text", *spans)
    loose = F.when(F.col("text").rlike("[0-9@]|[(\\[]at[)\\]]"), _found(F.col("text"), LOOSE)).otherwise(none)
    return rows.select("row", "doc_id", *KINDS, loose.alias("loose"))


def candidates(rows: DataFrame) -> DataFrame:
    """row, span, value and kind of what has a looser shape and overlaps no span of fixed format; `rows` are those of base()."""
    loose = rows.filter(F.size("loose") > 0)
    each = loose.select("row", F.explode("loose").alias("span"), F.lit(False).alias("fixed")).unionAll(loose.select("row", F.explode(F.concat(*KINDS)).alias("span"), F.lit(True).alias("fixed")))
    each = each.select("row", "span", "fixed", "span.start", "span.end")
    before = Window.partitionBy("row").orderBy("start", "end", "fixed").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("fixed")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(F.col("fixed"), F.col("end"))).over(before), F.lit(0))
    following = F.min(F.when(F.col("fixed"), F.col("start"))).over(after)
    each = each.withColumn("reach", reach).withColumn("following", following)
    free = each.filter("NOT fixed AND reach <= start AND (following IS NULL OR following >= end)")
    return free.select("row", "span", F.lower("span.value").alias("value"), F.explode(_kinds_of(F.col("span.value"))).alias("kind"))


def _plain(text: Column) -> Column:
    """Lower case, with digits standing for each other."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "0")


def _patterns(span: Column) -> Column:
    """Lexical patterns of a span: l1 and l2 (the word, the two words before it), r1 and r2 (after it), g (what is glued to its front)."""
    # a context that fills its room may begin or end amid a word, so words must have white space beside them
    left = F.when(F.length(span["left"]) < CONTEXT, F.concat(F.lit(" "), span["left"])).otherwise(span["left"])
    right = F.when(F.length(span["right"]) < CONTEXT, F.concat(span["right"], F.lit(" "))).otherwise(span["right"])
    take = lambda text, p: _plain(F.regexp_replace(F.regexp_extract(text, p, 1), rf"{_WS}+", " "))
    made = {
        "l1": take(left, rf"{_WS}({WORD}){_WS}+$"), "l2": take(left, rf"{_WS}({WORD}{_WS}+{WORD}){_WS}+$"), "g": take(left, rf"{_WS}({GLUED})$"),
        "r1": take(right, rf"^{_WS}+({WORD}){_WS}"), "r2": take(right, rf"^{_WS}+({WORD}{_WS}+{WORD}){_WS}"),
    }
    return F.filter(F.array(*[F.concat(F.lit(k + " "), v) for k, v in made.items()]), lambda p: ~p.rlike("^[a-z0-9]+ $") & (F.length(p) <= LONGEST))


def _totals(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """said and total: how often each text of `wanted` (said: a word, two words or what begins a word) occurs in all texts."""
    words = F.split(_plain(F.trim(F.col(text_col).cast("string"), F.lit(SPACE))), f"{_WS}+")
    rows = docs.select(words.alias("w")).filter("w IS NOT NULL")
    # each word beside the next one; what is said at a word is made after that, where whole-stage code makes it
    rows = rows.select("w", F.slice("w", F.lit(2), F.size("w")).alias("x")).select(F.explode(F.arrays_zip("w", "x")).alias("p")).select("p.w", "p.x")
    glued = F.contains("w", F.lit(":")) | F.contains("w", F.lit("=")) | F.contains("w", F.lit("#"))
    front = F.when(glued, F.concat(F.lit(FRONT), F.nullif(F.regexp_extract("w", f"^({GLUED}).", 1), F.lit(""))))
    said = rows.select(F.explode(F.array("w", F.concat("w", F.lit(" "), "x"), front)).alias("said"))
    few = wanted.count() <= BROADCAST_PATTERNS
    return said.join(F.broadcast(wanted) if few else wanted, "said", "left_semi").groupBy("said").agg(F.count("*").alias("total"))


def _kinds_of(value: Column) -> Column:
    """The kinds that a loosely shaped value may be."""
    n = F.length(_digits(value))
    number = ~value.rlike("[A-Za-z:@]")
    return F.filter(
        F.array(
            F.when(value.rlike("@|[(\\[]at[)\\]]"), F.lit("email")), F.when(value.rlike("^[0-9A-Fa-f:]+$") & value.contains(":"), F.lit("ip")),
            F.when(number & n.between(13, 19), F.lit("card")), F.when(number & n.between(7, 15), F.lit("phone")),
        ),
        lambda k: k.isNotNull(),
    )


def _edges(spans: DataFrame) -> DataFrame:
    """kind, pattern, value and times: how often each value stands in each pattern."""
    return spans.select("kind", "value", F.explode(_patterns(F.col("span"))).alias("pattern")).groupBy("kind", "pattern", "value").agg(F.count("*").alias("times"))


def believed(docs: DataFrame, rows: DataFrame, loose: DataFrame, text_col: str = "text", least: float = BELIEVED) -> DataFrame:
    """kind, value and belief of the candidates that their contexts identify; `rows` are those of base(), `loose` those of candidates(), both written.

    Patterns are of a kind, like the values in them. In each round, those take part in which MIN_SEEDS different values stand that are
    seeds or believed so far. A pattern's score is the share of its occurrences in the corpus that are seeds (each counts 1) or
    candidates (each counts its belief so far); so a word that stands beside anything scores low, and under MIN_SCORE it doesn't count.
    A candidate's belief is 1 - product(1 - score) over its patterns. Beliefs only grow; the rounds end when all of them together grow by less than GAIN, however many that takes.
    """
    seeds = reduce(DataFrame.unionAll, [rows.select(F.lit(k).alias("kind"), F.explode(k).alias("span")) for k in KINDS])
    fixed = _edges(seeds.select("kind", F.lower("span.value").alias("value"), "span")).groupBy("kind", "pattern").agg(F.count("*").alias("seeds"), F.sum("times").alias("seed_times"))
    edges = Settled(_edges(loose), "pii-edges")
    also = edges.df.groupBy("kind", "pattern").agg(F.count("*").alias("others"), F.sum("times").alias("other_times"))
    # a pattern without candidates reveals nothing; one that so few values stand in never counts
    able = also.join(fixed, ["kind", "pattern"], "left").na.fill(0, ["seeds", "seed_times"]).filter(F.col("seeds") + F.col("others") >= MIN_SEEDS)
    kind_of, said = F.split_part("pattern", F.lit(" "), F.lit(1)), F.regexp_replace("pattern", "^[a-z0-9]+ ", "")
    able = Settled(able.withColumn("said", F.when(kind_of == "g", F.concat(F.lit(FRONT), said)).otherwise(said)), "pii-able")
    belief = Settled(edges.df.select("kind", "value", F.lit(0.0).alias("belief")).limit(0), "pii-belief")
    if (able.df.agg(F.max("seeds")).first()[0] or 0) >= MIN_SEEDS:
        totals = _totals(docs, text_col, able.df.select("said").distinct())
        counted = able.df.join(totals, "said", "left").withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), F.col("seed_times") + F.col("other_times")))
        # nor does one ever count of whose occurrences too few are candidates or seeds
        patterns = Settled(counted.filter(F.col("seed_times") + F.col("other_times") >= MIN_SCORE * F.col("total")).select("kind", "pattern", "seeds", "seed_times", "total"), "pii-patterns")
        graph = Settled(edges.df.join(patterns.df.select("kind", "pattern"), ["kind", "pattern"], "left_semi"), "pii-graph")
        mass, grows = 0.0, not patterns.df.filter(F.col("seeds") >= MIN_SEEDS).isEmpty()
        while grows:
            held = graph.df.join(belief.df, ["kind", "value"], "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))
            sums = held.groupBy("kind", "pattern").agg(F.sum(F.col("belief") * F.col("times")).alias("mass"), F.count_if(F.col("belief") >= least).alias("sure"))
            scored = patterns.df.join(sums, ["kind", "pattern"]).filter(F.col("seeds") + F.col("sure") >= MIN_SEEDS).select("kind", "pattern", ((F.col("seed_times") + F.col("mass")) / F.col("total")).alias("score"))
            doubt = graph.df.join(scored.filter(F.col("score") >= MIN_SCORE), ["kind", "pattern"]).groupBy("kind", "value").agg(F.sum(F.log1p(-F.least("score", F.lit(0.999)))).alias("doubt"))
            after = Settled(doubt.select("kind", "value", (1 - F.exp("doubt")).alias("belief")), "pii-belief")
            belief.drop()
            belief, before = after, mass
            mass = after.df.agg(F.coalesce(F.sum("belief"), F.lit(0.0))).first()[0]
            grows = mass - before > GAIN * mass
        graph.drop()
        patterns.drop()
    edges.drop()
    able.drop()
    return belief.df.filter(F.col("belief") >= least)


def discovered(docs: DataFrame, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """row, kind, start and end of the candidates that are believed. One of several kinds goes to that of most belief, ties to the one listed first."""
    loose = Settled(candidates(rows), "pii-loose").df
    sure = believed(docs, rows, loose, text_col)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    hits = loose.join(sure, ["kind", "value"]).groupBy("row", "span.start", "span.end").agg(F.max_by("kind", F.struct("belief", -order)).alias("kind"))
    return hits.select("row", "kind", "start", "end")


def _ranked(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count per kind of fixed formats, base (their spans) and spans (all), both arrays of (kind, start, end), for every row.

    Starts and ends count code points, the end is exclusive. Spans come by kind as in KINDS, then by start. Spans of different
    kinds may overlap; those that contexts add overlap none of fixed format. Null texts count as empty and have no spans.
    Repeated rows get equal spans. Other columns aren't read. An empty table gives no rows.
    """
    rows = Settled(base(docs, id_col, text_col), "pii-spans").df
    added = discovered(docs, rows, text_col).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    joined = rows.join(added.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    kind_of = F.array(*map(F.lit, KINDS))
    fixed = F.concat(*(F.transform(k, _ranked(k)) for k in KINDS))
    more = F.transform(F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: F.struct((F.array_position(kind_of, s["kind"]) - 1).cast("int").alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    named = lambda a: F.transform(F.array_sort(a), lambda s: F.struct(F.get(kind_of, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), named(fixed).alias("base"), named(F.concat(fixed, more)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The spans as text, kind:start:end joined by commas, and the checksum of those of fixed format."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
