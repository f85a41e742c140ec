"""Hot bands, repeated and nameless rows, and scratch tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import common, lines, minhash, mixing
from tests.llm.test_ops import DOCS, WORDS, brute_classes, brute_targets, table


def test_hot_bands_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(12)
    base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(100)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(100)] = f"{rng.choice(WORDS)}{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block, hot in ((8, 10**9), (20, 5), (512, 1000)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "HOT", hot)
        assert {r["id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == brute_classes(rows)


def test_an_id_with_two_texts_keeps_one_of_each_class(spark):
    text = " ".join(f"w{k}" for k in range(60))
    near, other = text.replace("w59", "x59"), " ".join(f"v{k}" for k in range(60))
    rows = [(1, text), (5, near), (5, other), (5, other), (None, text), (7, other), (None, "lone words of no other row here"), (9, None), (9, None), (8, "")]
    got = corpus_pipeline.dedup_documents(spark, table(spark, [(i, t, "en", "s", 1) for i, t in rows]), "").collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, [(1, text), (5, other), (None, "lone words of no other row here"), (9, None), (8, "")]))


def test_nameless_and_repeated_rows_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    docs = [(None, "a b c", "en", "x", 1)] * 700 + [(None, None, "en", "x", 1)] * 30 + [(k, "w " * (k % 9 + 1), "en", "yz"[k % 2], 1) for k in range(400)]
    df = table(spark, docs).withColumn("copy", F.lit("clash"))
    got = mixing.digest(mixing.mix(df)).collect()
    assert len(got) == len(docs) and sum(r["doc_id"] is None for r in got) == 730
    sizes = {"x": 2100, "y": sum(k % 9 + 1 for k in range(0, 400, 2)), "z": sum(k % 9 + 1 for k in range(1, 400, 2))}
    want = brute_targets(sizes)
    taken = dict.fromkeys("xyz", 0)
    for r in got:
        taken["x" if r["doc_id"] is None else "yz"[r["doc_id"] % 2]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 10 for s in want)
    again = mixing.digest(mixing.mix(df.repartition(9))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("rows", [4096, 60])
def test_the_mix_balances_documents_too(spark, monkeypatch, rows):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", rows)
    rng = random.Random(3)
    docs = [(i, "w " * rng.choice([1, 3, 30, 200]), "en", rng.choice("abbccccd"), 1) for i in range(1200)]
    got = mixing.mix(table(spark, docs)).collect()
    for source in "abcd":
        mine = [r for r in got if r["source"] == source]
        times = mine[0]["target"] / mine[0]["source_size"]
        # probabilities move where neither documents nor words change in sum; only the last unit of a source falls by chance
        assert abs(sum(r["copies"] for r in mine) - times * len(mine)) <= 1 + 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{rng.randrange(10**6)}": rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(300)} | {None: 70, "": 3, "é": 9, "𝄞": 5, "￿": 4}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) <= 1e-6 * max(want[s], 1) for s in want) and len(got) == len(want)


def test_one_line_many_times_in_a_long_text(spark):
    text = "\n".join(["same", "own"] * 5000)
    docs = table(spark, [(i, text if i == 0 else "same", "en", f"s{i}", 1) for i in range(10)])
    got = {r["doc_id"]: r for r in lines.dedup(docs).collect()}
    assert got[0]["text"] == "\n".join(["own"] * 5000) and got[0]["n_removed"] == 5000 and got[3]["text"] == ""


def test_scratch_tables_go(spark):
    with common.scratch() as kept:
        one, two = common.Settled(spark.range(3), "a"), common.Settled(spark.range(4), "b")
        kept.append(two)
    assert one not in common.Settled.live and two.df.count() == 4
    two.drop()
    assert two not in common.Settled.live


def test_the_shared_folder_must_be_set_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())


def test_empty_tables(spark):
    assert minhash.classed(table(spark, [], DOCS)).count() == 0 and mixing.targets(spark.createDataFrame([], "source string, size long")).count() == 0
