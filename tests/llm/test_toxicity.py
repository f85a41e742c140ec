"""The classifier against plain code: features, log-count ratios, loss, and the whole fit."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import toxicity

WORDS = "ba ce di fo gu lan mer nix ops tur vel zim kor pal".split()


def bucket(gram):
    h = len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
        h ^= h >> 29
    return (h >> 20) % toxicity.BUCKETS


def grams(text):
    t = f" {' '.join(text.lower().split())} "
    return {bucket(t[i : i + n]) for n in toxicity.ORDERS for i in range(len(t) - n + 1)}


def ratios(rows):
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    has = {}
    for g, y in rows:
        for b in g:
            has.setdefault(b, [0, 0])[y] += 1
    out = {}
    for b, (c0, c1) in has.items():
        seen = c0 + c1
        chi = (c1 - seen * n[1] / sum(n)) ** 2 / (seen * n[1] / sum(n) * (1 - seen / (sum(n) + 1)))
        if chi > toxicity.MIN_CHI:
            out[b] = math.log((c1 + 1) / (n[1] + 2)) - math.log((c0 + 1) / (n[0] + 2))
    return out, n


def sample():
    rng = random.Random(6)
    rows = []
    for i in range(500):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(15)] + (["grumbletoad"] * (rng.random() < 0.8) + ["vilesnark"] * (rng.random() < 0.7) if bad else ["vilesnark"] * (rng.random() < 0.1))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_ngrams_are_hashed_one_by_one():
    for text in ("", "a", "Ab  c\n", "漢字 é 𝄞x", "word " * 9):
        assert set(toxicity.hashed(text).tolist()) == grams(text)


def test_loss_and_gradient():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(20, rng.integers(0, 9), replace=False)), int(rng.integers(2))) for _ in range(50)]
    ratio, x = rng.normal(size=20), rng.normal(size=21)
    loss, slope = toxicity.loss_of(rows, ratio, x, (0.02, 0.05))
    for k in range(21):
        d = np.zeros(21)
        d[k] = 1e-6
        assert abs((toxicity.loss_of(rows, ratio, x + d, (0.02, 0.05))[0] - toxicity.loss_of(rows, ratio, x - d, (0.02, 0.05))[0]) / 2e-6 - slope[k]) < 1e-6
    z = [sum(ratio[j] * x[j] for j in at) / math.sqrt(max(len(at), 1)) + x[-1] for at, _ in rows]
    assert abs(loss - sum((0.05 if y else 0.02) * math.log(1 + math.exp(-v if y else v)) for v, (_, y) in zip(z, rows, strict=True))) < 1e-9


def test_descent_ends_at_the_least_value():
    a = np.diag([1.0, 10.0, 100.0]) + 0.5
    x = toxicity.descend(lambda v: (0.5 * float((v - 3) @ a @ (v - 3)) + 1, a @ (v - 3)), np.zeros(3))
    assert np.allclose(x, 3, atol=0.02)


def test_fit_equals_plain_training(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7001, None), (7002, "")], "doc_id long, text string").withColumn("y", F.lit(5))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7003, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    trained = [(grams(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    ratio, n = ratios(trained)
    assert set(np.flatnonzero(model.weight).tolist()) <= set(ratio) and len(ratio) > 10
    order = sorted(ratio)
    place, r = {b: k for k, b in enumerate(order)}, np.array([ratio[b] for b in order])
    plain = [(np.array(sorted(place[b] for b in g if b in place), dtype=int), y) for g, y in trained]

    def f(x):
        loss, slope = toxicity.loss_of(plain, r, x, (0.5 / n[0], 0.5 / n[1]))
        w = np.append(x[:-1], 0.0)
        return loss + toxicity.RIDGE / 2 * float(w @ w), slope + toxicity.RIDGE * w

    x = toxicity.descend(f, np.append(np.full(len(order), 0.1), 0.0))
    assert np.allclose(model.weight[order], x[:-1] * r, atol=0.05) and abs(model.bias - x[-1]) < 0.05
    for text in ("grumbletoad here", rows[0][1], rows[1][1], None):
        at = [b for b in grams(text or "") if model.weight[b]]
        z = model.bias + sum(float(model.weight[b]) for b in at) / math.sqrt(max(len(at), 1))
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-6
