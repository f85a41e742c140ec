"""The isolation forest against a plain one: features, path lengths, scores and the calibrated threshold."""

from __future__ import annotations

import math
import random

import numpy as np

from ledgerline.llm import quality


def walk(forest, t, row):
    """The path length of a row in one tree, node by node."""
    k = 0
    while forest.feature[t, k] >= 0:
        k = 2 * k + 1 + int(row[forest.feature[t, k]] >= forest.cut[t, k])
    return forest.length[t, k]


def mean_path(n):
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def test_scores_are_mean_path_lengths(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 12)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    forest = quality.Forest.grow(x, 5)
    probe = np.concatenate([x[:60], rng.normal(size=(40, 4)) * 6])
    want = [2.0 ** (-sum(walk(forest, t, row) for t in range(12)) / 12 / mean_path(256)) for row in probe]
    assert np.allclose(forest.score(probe), want)
    assert np.mean(want[60:]) > np.mean(want[:60]) + 0.05


def test_leaves_hold_the_rows_that_splits_send_there(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 3)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(100, 3)), 1)  # with ties
    forest = quality.Forest.grow(x, 9)
    for t in range(3):
        leaves = {}
        for row in x:  # all rows are in every tree, as there are fewer than TREE_ROWS
            k, depth = 0, 0
            while forest.feature[t, k] >= 0:
                k, depth = 2 * k + 1 + int(row[forest.feature[t, k]] >= forest.cut[t, k]), depth + 1
            leaves.setdefault((k, depth), []).append(row)
        for (k, depth), rows in leaves.items():
            assert math.isclose(forest.length[t, k], depth + mean_path(len(rows)))
            assert len(rows) == 1 or depth == forest.depth or (np.array(rows) == rows[0]).all()


def test_threshold_equals_brute_force():
    rng = np.random.default_rng(2)
    for n_bad in (0, 1, 40):
        scores = np.round(np.concatenate([rng.uniform(0.3, 0.5, 900), rng.uniform(0.35, 0.8, n_bad)]), 3)
        good = np.arange(len(scores)) < 900
        best, want = -1.0, 1.0
        for c in sorted(set(scores.tolist())):
            alarm = sum(scores[good] > c) / good.sum()
            if alarm <= quality.FALSE_ALARMS:
                gain = (sum(scores[~good] > c) / n_bad if n_bad else 0.0) - alarm
                if gain > best:
                    best, want = gain, c
        assert quality.calibrated(scores, good) == want


def test_features_are_of_the_rule_statistics():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice(["a ", "bb ", "é# ", "c\n", "\n", "dd|", "one two three four five six\n"]) for _ in range(rng.randrange(80)))
        n, chars, symbols, dup, repeat, *features = quality.text_stats(text)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
        want = [symbols / (chars + 150), symbols / (n + 30), (chars + 150) / (n + 30), dup / (lines + 3) + repeat / (n + 30), math.log(n + 1)]
        assert np.allclose(features, want)


def test_every_labelled_row_counts(spark, monkeypatch):
    """Far more labelled rows than the trees need: each still grows a tree or calibrates the threshold."""
    monkeypatch.setattr(quality, "TREE_ROWS", 16)
    monkeypatch.setattr(quality, "TREES", 8)
    seen = {}
    grown, graded = quality.grown, quality.graded
    monkeypatch.setattr(quality, "grown", lambda rows: seen.setdefault("forest", (rows.count(), grown(rows)))[1])
    monkeypatch.setattr(quality, "graded", lambda rows, forest: seen.setdefault("threshold", graded(rows, forest)))
    n = 9_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('plain words that make up a text of some length with a number in it ', id, repeat(if(id % 9 = 0, ' $$#', ' word'), int(id % 4))) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 9 <> 0) AS quality")
    forest = quality.fit(docs, labels)
    rows = seen["forest"][0]
    good = sum(quality.seed_of("forest", i) % 2 == 0 for i in range(n) if i % 9)
    poor = sum(quality.seed_of("forest", i) % 2 == 0 for i in range(0, n, 9))
    assert rows == good + poor and rows + seen["threshold"][2].sum() == n
    # a tree's rows, of those that count: together the trees hold all of them once
    assert math.isclose(forest.rows * 8, good)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('a few words of a text that is not too short ', id, repeat(' $x', int(id % 5))) AS text")
    labels = spark.range(700).selectExpr("id AS doc_id", "int(id % 5 < 4) AS quality")
    one, two = quality.fit(docs, labels), quality.fit(docs.repartition(7, "text"), labels.repartition(3))
    assert one.threshold == two.threshold and (one.cut == two.cut).all() and (one.length == two.length).all()


def test_weights_count_as_rows():
    """A tree of rows that weigh 2 has the leaves of one where each stands twice."""
    x = np.random.default_rng(4).normal(size=(60, 3))
    one = quality.Forest.tree(x, np.full(60, 2.0), 6, np.random.default_rng(1))
    two = quality.Forest.tree(np.repeat(x, 2, 0), np.ones(120), 6, np.random.default_rng(1))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
