"""The three newest operators against brute force, and bounded fits."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import common, components, divergence, lines, quality, suffixes, toxicity, whitening
from ledgerline.llm.queries import ORACLES, QUERIES

from ..compare import SF, expected, rows_of

TEXTS = "doc_id long, text string, lang string, source string"


def removed(texts: list[bytes]) -> list[tuple[int, int, int, str]]:
    """What op11 tells of each text, by counting every string of MIN_BYTES."""
    n = suffixes.MIN_BYTES
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        gone = gone[: len(t)]
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) > 0).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def copies(seed: int) -> list[bytes]:
    rng = random.Random(seed)
    letters = [b"ab", bytes(range(97, 123)) + b" ", "äö字 x".encode()][seed % 3]
    base = [bytes(rng.choice(letters) for _ in range(rng.randint(350, 1300))) for _ in range(4)]
    out = [b"", b"a" * 399, b"a" * 900, b"ab" * 500]
    for _ in range(14):
        t = bytearray(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = 120
        out.append(bytes(t[rng.randrange(200) :] + rng.choice(base)[: rng.randint(0, 500)]))
    return [*out, out[-1], out[5]]


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion_finds_every_repeated_string(seed):
    texts = copies(seed)
    found = suffixes.repeated_starts(texts, [k << 40 for k in range(len(texts))])
    for t, starts, (_, n, _, _) in zip(texts, found, removed(texts), strict=True):
        gone = np.zeros(len(t), bool)
        for i in starts:
            gone[i : i + suffixes.MIN_BYTES] = True
        assert gone.sum() == n


def test_overlapping_pieces_of_a_text_are_no_repeat():
    rng = random.Random(3)
    t = bytes(rng.choice(b"abcdefgh") for _ in range(1000))
    assert all(len(s) == 0 for s in suffixes.repeated_starts([t[:700], t[200:]], [0, 200]))


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeats_go_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = [t.decode() for seed in (0, 1) for t in copies(seed)] + [None, "x" * 399]
    rows = [(k, t, "n", "s") for k, t in enumerate(texts)] + [(5, texts[5], "n", "s"), (None, texts[6], None, None)]
    docs = spark.createDataFrame(rows, TEXTS).withColumn("n_bytes", F.lit("clash"))
    got = suffixes.digest(suffixes.remove_repeats(docs))
    assert Counter(tuple(r) for r in got.collect()) == Counter((r[0], *w) for r, w in zip(rows, removed([(r[1] or "").encode() for r in rows]), strict=True))
    assert "lang" in suffixes.remove_repeats(docs).columns


def test_a_slice_of_a_long_text_has_the_anchors_of_the_whole(monkeypatch):
    rng = random.Random(9)
    t = bytes(rng.choice(b"abc") for _ in range(9000))
    whole = suffixes.anchors(t)
    monkeypatch.setattr(suffixes, "SLICE", 1000)
    assert all((a == b).all() for a, b in zip(whole, suffixes.anchors(t), strict=True))


def test_no_documents_no_repeats(spark):
    assert suffixes.digest(suffixes.remove_repeats(spark.createDataFrame([], TEXTS))).collect() == []


def vectors(n=60, dims=40):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) / 8
    return x.astype(np.float32)


def test_whitening_against_plain_arithmetic(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 7)
    x = vectors()
    bad = [(90, None), (91, [1.0] * 39 + [None]), (92, [float("nan")] * 40), (93, [float("inf")] + [0.0] * 39), (94, []), (95, [1.0, 2.0])]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + bad + [(0, x[0].tolist()), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("whitened", F.lit(1)).repartition(3)
    got = whitening.whiten(df).toPandas()
    m = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in [*x, x[0], x[1]]]
    n, s = len(m), [sum(c) for c in zip(*m, strict=True)]
    assert set(got["n"]) == {n} and len(got) == n * whitening.COMPONENTS and got["identity_error"].iloc[0] < 1e-9
    deviation = Counter(sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in m)
    assert Counter(got[got["component"] == 1]["deviation"]) == deviation
    e, w = np.linalg.eigh(np.cov(np.array(m, float).T, bias=True))
    e, w = e[::-1][:32], w[:, ::-1][:, :32]
    z = (np.array(m) - np.array(s) / n) @ w / np.sqrt(e)
    mine = got[got["vec_id"] == 7].sort_values("component")["whitened"].to_numpy()
    assert np.allclose(np.abs(mine), np.abs(z[7]), atol=1e-8)
    shares = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, e / np.trace(np.cov(np.array(m, float).T, bias=True)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance_no_components(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_flat_directions_are_left_out(spark):
    got = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(5)], "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-9


def test_large_numbers_stay_exact():
    x = np.array([[2**40, -(2**40)], [3, 5]])
    assert whitening.deviations(x, 2, [2**40 + 3, 5 - 2**40]) == [None, None] and whitening.deviations(x[1:], 2, [6, 9]) == [1]


def audited(rows: list[tuple], min_docs: int) -> Counter:
    """op13 by plain arithmetic on whole numbers."""
    import re

    rows = [((s or ""), (lang or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))) for _, t, lang, s in rows]
    out = Counter()
    for lang in {r[1] for r in rows}:
        docs = Counter(w for _, x, words in rows if x == lang for w in set(words))
        kept = {w for w, n in docs.items() if n >= min_docs}
        count = {s: Counter(w for s2, x, words in rows if (s2, x) == (s, lang) for w in words if w in kept) for s in {s for s, x, _ in rows if x == lang}}
        every = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in count.items():
            pairs = [(o, sum(f(p(c, w), p(d, w)) for w in kept)) for o, d in count.items() if o != s]
            terms = [(w, f(p(c, w), p(every, w))) for w in kept if c[w] and p(c, w) > p(every, w)]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, divergence.TOP)):
                for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top], 1):
                    out[lang, s, part, item, value, k] += 1
    return out


@pytest.mark.parametrize(("chunk", "block"), [(4096, 32), (3, 2)])
def test_audit_against_plain_arithmetic(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "PART", 1 + (chunk > 3))
    rng = random.Random(2)
    words = ["Ab", "ab", "Äb", "äb", "c1d", "字", "x_y", "zz", "Q"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["n", "m", None]), rng.choice(["s1", "s2", "S2", "ß", None, ""])) for k in range(80)]
    rows += [(90, None, "only", "a"), (91, "", "only", "b"), (92, "1 2", "alone", None), (0, rows[0][1], rows[0][2], rows[0][3])]
    got = divergence.audit(spark.createDataFrame(rows, TEXTS).withColumn("rank", F.lit(0)).repartition(3), min_docs=4)
    assert Counter(tuple(r) for r in got.collect()) == audited(rows, 4)


def test_no_documents_no_audit(spark):
    assert divergence.audit(spark.createDataFrame([], TEXTS)).collect() == []


def test_shares_are_exact():
    for count, total, kept in ((0, 0, 1), (7, 100, 3), (10**12, 3 * 10**12 + 7, 10**6)):
        assert int(divergence.shares(np.array([count]), total, kept)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * kept)


@pytest.mark.parametrize("name", ["op13_source_divergence"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert rows_of(df.columns, df.collect()) == expected(ORACLES[name])


def test_an_id_of_many_rows_is_one_row_of_a_fit(spark):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word " * 12), F.col("id").cast("string")).alias("text"))
    one = common.one_text(docs, ["doc_id"], "text").collect()
    assert len(one) == 1
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    both = docs.unionByName(spark.createDataFrame([(8, "some other text of ten words or a few more here")], "doc_id long, text string"))
    assert quality.fit(both, labels).rows == 1
    held = [i for i in (7, 8) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert toxicity.fit(both, labels).bias == pytest.approx(toxicity.fit(both.dropDuplicates(["doc_id"]), labels).bias, abs=1e-6) or held


def test_mixing_tells_rows_apart(spark):
    rows = [(7, None, "u1"), (None, "7", "u1"), (7, None, "u2"), (7, "", "u1"), (9, "s", "u"), (9, "s", "u")]
    docs = spark.createDataFrame([Row(doc_id=i, text="a b c", lang="n", source=s, n_chars=5, url=u) for i, s, u in rows], "doc_id long, text string, lang string, source string, n_chars long, url string")
    got = Counter((r["doc_id"], r["source"], r["url"]) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    have = Counter(rows)
    assert set(got) <= set(have) and all(n <= 2 * have[k] for k, n in got.items())
    mixed = corpus_pipeline.mixing.mix(docs.select("doc_id", "text", "source"), key=F.lit("k"))
    assert sum(got.values()) > 0 and mixed.count() == len(rows)


def test_scratch_keeps_what_the_result_reads_alone(spark):
    from ledgerline.llm import warc

    with common.scratch() as kept:
        pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000)], "page_id long, url string, html string")
        assert warc.round_trip(pages).count() == 2
        assert any("/archive-" in t.path for t in common.Folder.live)
    assert kept == [] and not any("/archive-" in t.path for t in common.Folder.live)


def most_of_a_task(df) -> float:
    """The share of all rows that the largest partition has."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / sum(n)


@pytest.fixture
def as_dealt(spark):
    """Joins by shuffles alone, and partitions as they were dealt."""
    had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(had, ("false", "-1", "8"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def test_a_hub_stays_where_its_links_are(spark, monkeypatch, as_dealt):
    links = spark.range(4000, numPartitions=8).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(300).select((F.col("id") + 10_000).alias("a"), (F.col("id") + 20_000).alias("b")))
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    together = most_of_a_task(components._with_least(ends, least))
    monkeypatch.setattr(components, "HUB", 1000)
    assert together > 0.9 and most_of_a_task(components._with_least(ends, least)) < 0.2
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {k: -1 for k in range(4000)} | {k + 20_000: k + 10_000 for k in range(300)}


def test_occurrences_of_a_line_are_dealt(spark, as_dealt):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line\nown "), F.col("id").cast("string")).alias("text"), (F.col("id") % 40).cast("string").alias("source"))
    rows = lines.exploded(docs, "doc_id", "text", "source")
    found = lines.spread(rows)
    assert found.count() == 1 and most_of_a_task(rows.join(found, ["h1", "h2"])) == 1.0 and most_of_a_task(lines.occurrences(rows, found)) < 0.4
    assert lines.dedup(docs).agg(F.sum("n_removed")).first()[0] == 3000
