"""The training-data operators against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

import corpus_pipeline
from ledgerline.llm import components, language, lines, minhash, mixing, packing, pii, quality, queries, toxicity, vectors, warc
from ledgerline.llm.common import new_path
from tests.compare import SF, expected, rows_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "ba ce di fo gu lan mer nix ops tur vel zim kor pal".split()


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def odd_docs(spark):
    """Null, empty, blank, very long, repeated and id-less rows, with columns that clash with inner names."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 30_000), (5, "a b c"), (5, "a b c"), (None, "x y z w v u"), (6, "A\x01b é 漢字 " * 5)]
    df = table(spark, [(i, t, "en", None if i == 1 else "s", None) for i, t in rows])
    for c in ("id", "key", "p", "size", "block", "digest", "score", "_text", "_id", "row", "band", "word", "n_lines"):
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert rows_of(df.columns, df.collect()) == expected(queries.ORACLES[name])


# 1: quality


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_rule_statistics():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a ", "b ", "é# ", "c\n", "\n", " \t", "dd|"]) for _ in range(rng.randrange(60)))
        assert quality.text_stats(text)[:5] == brute_stats(text)
    assert quality.text_stats(None)[:5] == (0, 0, 0, 0, 0)


def test_quality_parts_junk_from_prose(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randrange(30, 80))]
        bad = i % 6 == 0
        docs.append((i, " ".join(w + "$$$" if bad else w for w in words), "en", "s", 1))
        labels.append((i, 0 if bad else 1, 0))
    got = {r["doc_id"]: r for r in quality.quality(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(not got[i]["kept"] for i in range(600) if i % 6 == 0) >= 95
    assert sum(not got[i]["kept"] for i in range(600) if i % 6) <= 5
    odd = quality.quality(odd_docs(spark), spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int"))
    assert odd.count() == 8 and odd.filter("doc_id in (1, 2, 3)").filter("base_failed and not kept").count() == 3
    assert quality.quality(table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# 2: WARC


def test_archives_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "http://c\r\nX-Bad: 1", None), (4, None, "small"), (5, "u", "small"), (None, "n", big), (6, "http://é", "é" * 600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = new_path(spark, "warc")
    warc.write(warc.records(pages), path)
    got = {r["record_id"]: r for r in warc.read(spark, path).collect() if r["record_type"] != "warcinfo"}
    assert len(got) == 7
    assert got["<urn:page:2>"]["payload"] == big.encode() and got["<urn:page:2>"]["record_type"] == "response"
    assert got["<urn:page:1>"]["record_type"] == "revisit" and got["<urn:page:1>"]["refers_to"] == "<urn:page:2>" and got["<urn:page:1>"]["payload_bytes"] == len(big)
    assert got["<urn:page:3>"]["payload"] == b"" and got["<urn:page:4>"]["record_type"] == got["<urn:page:5>"]["record_type"] == "response"
    assert got["<urn:page:6>"]["payload_digest"] == hashlib.sha1(("é" * 600).encode()).hexdigest()
    only = warc.read(spark, path, "headers").filter("record_type = 'revisit' and target_uri = 'http://a'")
    assert [r["record_id"] for r in only.collect()] == ["<urn:page:1>"]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_predicates_are_pushed():
    reader = warc.WarcReader("x", "headers")
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("a", "b")), EqualTo(("payload_bytes",), 1)]))
    assert [f.attribute for f in left] == [("payload_bytes",)]
    assert reader.wanted({"warc-type": "revisit", "warc-target-uri": "b"}) and not reader.wanted({"warc-type": "revisit"}) and not reader.wanted({"warc-type": "response", "warc-target-uri": "a"})


def test_any_gzip_archive_is_read(spark, tmp_path):
    records = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{k}>", "Content-Type": "text/plain"}, b"z" * n) for k, n in enumerate((0, 10, 300_000))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = warc.read(spark, f"file://{tmp_path}").orderBy("record_id").collect()
    assert [r["payload_bytes"] for r in got] == [0, 10, 300_000]
    assert warc.read(spark, f"file://{tmp_path}", "headers").filter("record_id = '<urn:page:2>'").count() == 1


# 3: lines


def test_spread_lines_go(spark):
    rows = [(i, f"own line {i}\n  common \n\nfew" if i < 3 else f"common\nown {i}", "en", f"s{i % 9}", 1) for i in range(30)] + [(40, None, "en", "s1", 1), (41, "", "en", None, 1), (42, "common", "en", None, 0), (42, "common", "en", None, 0)]
    docs = table(spark, rows).withColumn("line", F.lit(1)).withColumn("n_removed", F.lit("mine")).withColumn("_gone", F.lit(2))
    got = {(r["doc_id"]): r for r in lines.dedup(docs).collect()}
    assert got[0]["text"] == "own line 0\n\nfew" and got[0]["n_removed"] == 1 and got[0]["n_lines"] == 3
    assert got[5]["text"] == "own 5" and got[40]["text"] is None and got[40]["n_lines"] == 0 and got[41]["text"] == "" and got[42]["text"] == ""
    assert lines.dedup(docs).count() == len(rows)
    assert lines.dedup(docs.limit(0)).count() == 0


def test_exact_counts_near_the_threshold(spark):
    for n in range(1, 14):
        docs = table(spark, [(i, "same", "en", f"s{i}", 1) for i in range(n)])
        assert lines.dedup(docs).filter("n_removed > 0").count() == (n if n >= lines.MIN_SITES else 0)


# 4: personal data

FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in FORMATS.items():
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_formats_equal_brute_force(spark):
    rng = random.Random(11)
    parts = ["a.b%c@d-e.f", "@x.y", "_z@q.w", "1.2.3.4.5.6.7.8", "300.1.1.1", "0255.001.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+49 1", " ", "é漢", ".", "+12", "9", "-", "\n", "\x01", "𝄞"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for i in range(400)] + [(900, None), (901, ""), (902, "1" * 50_000), (903, "a" * 50_000 + "@"), (904, "a@b.c" * 3000)]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")))).collect()}
    for i, text in rows:
        assert got[i]["base_sha256"] == hashlib.sha256(brute_spans(text).encode()).hexdigest(), (i, (text or "")[:200])
        assert set(filter(None, brute_spans(text).split(","))) <= set(got[i]["spans"].split(","))


def test_contexts_reveal_other_identifiers(spark):
    rows = [(i, f"noise the word and callme: +1 (499) 555-65{i:02d} more of the") for i in range(12)]
    rows += [(100, "reach callme: 499 555 6503 now"), (101, "the 499 555 6503 number"), (102, "nothing of the kind 12 here")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[100]["spans"]] == [("phone", 14, 26)]
    assert got[100]["n_phone"] == 0 and got[102]["spans"] == [] and got[0]["n_phone"] == 1
    plain = [(i, f"the {i} and +1 (499) 555-65{i:02d} of the 300 400 500 {i}") for i in range(12)] + [(50, "words and 777 888 99 of")]
    plain += [(200 + i, "words and things of all kinds and and") for i in range(50)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(plain, "doc_id long, text string")).collect()}
    assert got[50]["spans"] == []  # a word that stands beside anything identifies nothing
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 5: vectors


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    p = vectors.decode_e8(x)
    for q in (p[:, None, :] + vectors._SHORT[None]).transpose(1, 0, 2):
        assert (((x - p) ** 2).sum(1) <= ((x - q) ** 2).sum(1) + 1e-9).all()
    assert len(np.unique(vectors._SHORT, axis=0)) == 240 and np.allclose((vectors._SHORT**2).sum(1), 2)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 64))
    rows = []
    for i in range(400):
        v = base[i % 30] + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.15, 0.3])
        rows.append((i, (v * 3).tolist(), i % 2))
    rows += [(500 + k, rows[0][1], 0) for k in range(40)]  # copies
    rows += [(600, None, 0), (601, [0.0] * 64, 0), (602, [None] + [1.0] * 63, 0), (603, [float("nan")] + [1.0] * 63, 1), (604, [], 1), (605, rows[0][1], None), (606, [1.0, 2.0], 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    ok = [r for r in rows[:440]]
    m = np.array([r[1] for r in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.98) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None])
    np.fill_diagonal(near, False)
    found = sum(got[r[0]]["n_links"] for r in ok)
    assert near.sum() * 0.99 <= found <= near.sum() and near.sum() > 1000
    assert all(got[r[0]]["n_links"] <= n for r, n in zip(ok, near.sum(1), strict=True))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (600, 601, 602, 603, 604, 605, 606, None))
    assert len(got) == len({r[0] for r in rows})


def test_hot_lattice_points_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    rows = [(i, (centre + rng.normal(size=64) * 0.02).tolist(), 1) for i in range(300)]
    monkeypatch.setattr(vectors, "BLOCK", 40)
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 299 and r["component_id"] == 0 for r in got)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (200, 0)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 200: 0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6: mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_meets_its_targets(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.choice([1, 5, 50, 400])), "en", rng.choice(["a", "b", "c", "d", None, "big", "big", "big"]), 1) for i in range(3000)] + [(9000, None, "en", "a", 1), (9001, "", "en", "e", 0)]
    df = table(spark, docs).withColumn("p", F.lit(1))
    sizes = collections.Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len((t or "").split())
    for rows in (4096, 100):
        monkeypatch.setattr(mixing, "BLOCK_ROWS", rows)
        got = mixing.digest(mixing.mix(df)).collect()
        source = {d[0]: d[3] for d in docs}
        want, taken, target = brute_targets(sizes), collections.Counter(), {}
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
            target[source[r["doc_id"]]] = r["target"]
            assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert len(got) == len(docs) and all(abs(target[s] - want[s]) < 1e-6 * max(want[s], 1) for s in want)
        assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 10 for s in want), (rows, taken, want)
    again = mixing.digest(mixing.mix(df.repartition(7))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    p, size = [0.3] * 200, rng.integers(1, 500, 200).astype(float).tolist()
    before = sum(p), sum(a * b for a, b in zip(p, size, strict=True))
    units = mixing.fly(p, size, rng)
    assert len(units) <= 2 and abs(sum(p) - before[0]) < 1e-6 and abs(sum(a * b for a, b in zip(p, size, strict=True)) - before[1]) < 1e-3


# 7: toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40)] + (["grumbletoad", "vilesnark"] if bad else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    df, lab = table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity(df, lab).collect() if r["held_out"]]
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(900))
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got) >= 0.97 * len(got)
    odd = toxicity.toxicity(odd_docs(spark), lab)
    assert odd.count() == 8 and odd.filter("score between 0 and 1").count() == 8
    assert toxicity.toxicity(df.limit(0), lab).count() == 0
    assert toxicity.toxicity(df, lab.limit(0)).filter("predicted = 1").count() == 0


# 8: packing


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["Hello, World! it's 3 o'clock.", None, "", "ÉTÉ à la Straße, naïve", "<|endoftext|> x", "漢字 Σίσυφος Œuvre ǅ", "don't,stop...now!? a.b 12ab", "İstanbul Ĳ ŉ", " \t\n\x0b ", "word " * 9000, "ab́c \x85 x y z"]
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1), (None, "id less", "en", "s", 1)])
    pieces = packing.pack(docs).collect()
    by_seq = collections.defaultdict(list)
    for r in pieces:
        by_seq[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    for i, t in enumerate(texts):
        if i:
            ids = b"".join(r["ids"] for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]))
            assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2], t
    assert sum(r["length"] for r in pieces if r["doc_id"] == 0) == 2 * next(r["doc_tokens"] for r in pieces if r["doc_id"] == 0)
    assert packing.pack(docs.limit(0)).count() == 0


def test_words_are_tokenized_as_whole_texts_are(spark):
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect():
        assert np.frombuffer(own.encode(r["text"]), "<u4").tolist() == whole.encode(r["text"], add_special_tokens=False).ids


def test_blocks_leave_no_gaps():
    rng = random.Random(1)
    pieces = [(k, 0, rng.randrange(1, 9000)) for k in range(300)]
    full, left = packing.pack_block(pieces, 4096, False)
    assert all(sum(p[2] for p in s) == 4096 for s in full) and sum(p[2] for p in left) < 4096
    last, none = packing.pack_block(pieces, 4096, True)
    assert not none and len(last) * 4096 - sum(p[2] for p in pieces) < 4096


# 9: near duplicates


def brute_classes(rows):
    sets = {i: collections.Counter((lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])((t or "").split())) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) + rng.choice(WORDS) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(180):  # a hot group and others, with edits that lie about the threshold
        w = list(base[0 if i % 3 else rng.randrange(6)])
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(120)] = rng.choice(WORDS) + str(i)
        rows.append((i, " ".join(w)))
    rows += [(300, "one two"), (301, "one  two\n"), (302, None), (303, ""), (304, "x " * 400), (305, "x " * 300), (306, "x " * 390)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("digest", F.lit(1))
    want = brute_classes(rows)
    for block in (512, 16):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r["id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()}
        assert got == want
    kept = minhash.near_duplicates(df).filter("kept").count()
    assert kept == len(set(want.values()))
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, minhash.near_duplicates(twice).collect()))) == sorted(map(str, [(1, 1, True), (1, 1, True), (None, 1, False), (2, 2, True)]))


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(30):
        items = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
        a, b = rng.integers(1, 6, 200), rng.integers(1, 6, 200)
        b[:100] = a[:100]
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        same = minhash.signature(items, a.astype(np.uint64)) == minhash.signature(items, b.astype(np.uint64))
        errors.append(same.mean() - true)
    assert abs(np.mean(errors)) < 0.02


# 10: language


def longest_phrases(text, reference):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in reference:
            n += 1
        at, count = at + max(n - 1, 1), count + 1
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(0)
    ref = {"aa": " ".join(rng.choice(WORDS[:7]) for _ in range(200)), "bb": " ".join(rng.choice(WORDS[7:]) for _ in range(200))}
    langs = language.build({k: [v] for k, v in ref.items()})
    for _ in range(30):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60)))
        assert langs.phrases([text])[0].tolist() == [longest_phrases(text, ref["aa"]), longest_phrases(text, ref["bb"])]


def test_language_on_held_out_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.language(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = {r["doc_id"]: r for r in language.language(odd_docs(spark)).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[3]["lang_pred"] == "und" and odd[5]["lang_pred"] == "en"
    assert language.language(df.limit(0)).count() == 0
    assert language.language(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_wordless_languages_win_nothing(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(-k, text, lang) for k in range(1, 30) for text, lang in (("123", "aa"), ("", "xx"))]
    more = df.select("doc_id", "text", "lang").union(table(spark, rows, "doc_id long, text string, lang string"))
    langs = language.fit(more)
    assert langs.names == ["aa", "de", "en", "es", "fr", "xx"]
    texts = [r["text"] for r in df.filter("text is not null").orderBy("doc_id").collect()]
    assert langs.predict(texts)[0] == language.fit(df).predict(texts)[0]
    # a single letter is a phrase in every language, but only in the one without words is it a literal
    assert language.build({"aa": [], "en": ["the cat"]}).predict(["c", "cat", "1", "я"])[0] == ["en", "en", "und", "aa"]


def test_all_letters_of_all_scripts_are_known():
    rng = random.Random(1)
    ref = {}
    for name, first, n in (("el", 0x3B1, 17), ("la", 0x61, 26), ("ru", 0x430, 32), ("zh", 0x4E00, 900)):
        words = ["".join(chr(first + rng.randrange(n)) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
        ref[name] = " ".join(words[: 40 if name in ("el", "zh") else 400])
    langs = language.build({k: [v] for k, v in ref.items()})
    for own, said in ref.items():
        words = said.split()
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 30))) for _ in range(10)] + [said[7:90], rng.choice(said.replace(" ", ""))]
        assert langs.predict(texts)[0] == [own] * len(texts)
        mixed = [t + rng.choice(texts) + rng.choice(list(ref.values()))[:40] for t in texts]
        phrases, literals = langs.counts(mixed)
        assert phrases.tolist() == [[longest_phrases(t, ref[k]) for k in langs.names] for t in mixed]
        assert literals.tolist() == [[sum(c not in ref[k] for c in t) for k in langs.names] for t in mixed]


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language", "lines", "near duplicates", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0
    ids = {r[0] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids


def test_pipeline_takes_odd_rows(spark):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 0, name


def test_pipeline_takes_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), SF).count() == 0
