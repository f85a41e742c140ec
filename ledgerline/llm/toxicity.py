"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams that occur in it, however often. Each feature is scaled by the naive
Bayes ratio log(P(n-gram | toxic) / P(n-gram | other)) over the training rows; logistic regression then learns a factor for
each scaled feature. Both come from a bounded sample of labelled rows. The sample stays on the executors: they count n-grams, and for
each step of the descent they sum loss and gradient of their rows, so that only vectors as long as the features reach the driver.
Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled, held_out, map_texts, one_text

#: Lengths of the n-grams, in characters, and the number of hash buckets (a power of two).
ORDERS = (4, 5, 6)
BUCKETS = 1 << 18
#: Bound of the fit: labelled rows of each class.
SAMPLE_ROWS = 4_000
#: A bucket is a feature if its chi-square against the label exceeds this, which hardly one without a bearing on it does by chance (1 in 600).
MIN_CHI = 10.0
SAMPLE_PARTS = 8
#: Count added to each n-gram, weight of the squared factors against the loss, gain in loss below which the descent ends, and steps it remembers.
SMOOTHING, RIDGE, GAIN, MEMORY = 1.0, 1e-4, 1e-4, 8

_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(text: str) -> np.ndarray:
    """Buckets of a text's n-grams, each once; letters count as lower case and white space runs as one space."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    found = []
    for n in ORDERS:
        if len(chars) >= n:
            h = np.full(len(chars) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ chars[k : len(chars) - n + 1 + k]) * _MIX
                h ^= h >> np.uint64(29)
            found.append((h >> np.uint64(20)) & np.uint64(BUCKETS - 1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    """Weight of each bucket (0: not a feature) and the intercept."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = hashed(text or "")
        at = at[self.weight[at] != 0]
        at = np.unique(at)
        z = self.bias + self.weight[at].sum() / np.sqrt(max(len(at), 1))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def choose(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """The features, ascending, which are all buckets that the label has to do with, and their naive Bayes ratios, from the toxic and other rows that have each."""
    ratio = np.log((c1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((c0 + SMOOTHING) / (n0 + 2 * SMOOTHING))
    seen = c1 + c0
    expected = seen * n1 / max(n1 + n0, 1)
    chi = (c1 - expected) ** 2 / np.maximum(expected * (1 - seen / (n1 + n0 + 1)), 1e-9)
    kept = np.flatnonzero(chi > MIN_CHI)
    return kept, ratio[kept]


def loss_of(rows: list[tuple[np.ndarray, int]], ratio: np.ndarray, x: np.ndarray, share: tuple[float, float]) -> tuple[float, np.ndarray]:
    """Weighted logistic loss of rows (positions of their features, label) and its gradient, at factors and intercept x.

    A row's features are scaled by `ratio` and divided by the root of their number; `share` is the weight of a row of either label.
    """
    loss, slope, w = 0.0, np.zeros(len(x)), ratio * x[:-1]
    for at, y in rows:
        root = np.sqrt(max(len(at), 1))
        z = w[at].sum() / root + x[-1]
        loss += share[y] * float(np.logaddexp(0.0, -z if y else z))
        e = share[y] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        slope[at] += e / root
        slope[-1] += e
    slope[:-1] *= ratio
    return loss, slope


def descend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where a convex function (value and gradient) is least: L-BFGS, from x, until a step gains less than GAIN of the value."""
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, g = f(x)
    while True:
        d, shares = -g, []
        for s, y, c in reversed(moves):
            shares.append(float(s @ d) / c)
            d = d - shares[-1] * y
        if moves:
            s, y, c = moves[-1]
            d = d * (c / float(y @ y))
        for (s, y, c), share in zip(moves, reversed(shares), strict=True):
            d = d + (share - float(y @ d) / c) * s
        size = 1.0 if moves else min(1.0, 1 / max(float(np.abs(g).sum()), 1e-12))
        while True:
            there = x + size * d
            new, slope = f(there)
            if new <= value + 1e-4 * size * float(g @ d) or size < 1e-8:
                break
            size /= 2
        s, y = there - x, slope - g
        if (c := float(s @ y)) > 1e-15:
            moves = [*moves[1 - MEMORY :], (s, y, c)]
        gain, x, value, g = value - new, there, new, slope
        if gain < GAIN * max(abs(value), 1e-3):
            return x


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Train on labelled rows that aren't held out, at most `sample_rows` of each class: those of the smallest hashed ids.

    All n-grams in these rows' whole texts that the label has to do with are features, however many. An id with several labels counts as toxic if one says so; of rows that share an id
    one is taken, that of the smallest hashed text. Rows without id or label are left out. Without rows of both classes, every text gets the score of the one there is (none: not toxic).
    """
    order = F.xxhash64(F.lit("toxic"), F.col("id"))
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"), 5, 0)).groupBy("id").agg(F.max("y").alias("y"))
    )
    some = known.filter("y = 1").orderBy(order, "id").limit(sample_rows).unionAll(known.filter("y = 0").orderBy(order, "id").limit(sample_rows))
    # the sample is bounded by 2 * sample_rows rows of an id and a label, and so is what it picks
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id")
    picked = one_text(found, ["id", "y"], "text")
    sample = Settled(picked.repartition(SAMPLE_PARTS, "id").sortWithinPartitions("id"), "toxicity")
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, BUCKETS), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                c[y, np.unique(hashed(t or ""))] += 1
                rows[y] += 1
        at = np.flatnonzero(c.any(0))
        columns = [np.append(at, -1), np.append(c[1, at], rows[1]), np.append(c[0, at], rows[0])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["bucket", "c1", "c0"])

    sums = sample.df.mapInArrow(count, "bucket long, c1 long, c0 long").groupBy("bucket").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).toPandas()
    c1, c0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    own = sums[sums["bucket"] >= 0]
    c1[own["bucket"]], c0[own["bucket"]] = own["c1"], own["c0"]
    rows = sums[sums["bucket"] < 0]
    n1, n0 = int(rows["c1"].sum()), int(rows["c0"].sum())
    weight = np.zeros(BUCKETS, dtype=np.float32)
    if not n1 or not n0:
        sample.drop()
        return Model(weight, 30.0 if n1 else -30.0)
    kept, ratio = choose(c1, c0, n1, n0)
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept))
    numbers = spark.sparkContext.broadcast(number)

    def make():
        number = numbers.value

        def run(texts: list[str | None]) -> dict[str, list]:
            found = (number[np.unique(hashed(t or ""))] for t in texts)
            return {"at": [x[x >= 0].astype("<i4").tobytes() for x in found]}

        return run

    made = Settled(map_texts(sample.df, [F.col("y")], F.col("text"), make, "at binary"), "toxicity-features")
    sample.drop()
    # both classes weigh the same, so that 0.5 parts them
    share = 0.5 / n0, 0.5 / n1

    def summed(x: np.ndarray) -> tuple[float, np.ndarray]:
        here = spark.sparkContext.broadcast((x, ratio))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, ratio = here.value
            for b in batches:
                rows = [(np.frombuffer(a, dtype="<i4"), y) for a, y in zip(b.column("at").to_pylist(), b.column("y").to_pylist(), strict=True)]
                loss, slope = loss_of(rows, ratio, x, share)
                yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], type=pa.binary())], names=["loss", "slope"])

        parts = made.df.mapInArrow(run, "loss double, slope binary").collect()
        here.destroy()
        slope = np.sum([np.frombuffer(p["slope"]) for p in parts], axis=0)
        w = np.append(x[:-1], 0.0)
        return sum(p["loss"] for p in parts) + RIDGE / 2 * float(w @ w), slope + RIDGE * w

    x = descend(summed, np.append(np.full(len(kept), 0.1), 0.0))
    made.drop()
    weight[kept] = (x[:-1] * ratio).astype(np.float32)
    return Model(weight, float(x[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (not used in training), score (0 to 1; higher: likelier toxic) and predicted (1 from 0.5 up), for every row.

    Null and empty texts have no features: their score is that of the intercept. Repeated rows get equal scores. Other columns
    are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def run(texts: list[str | None]) -> dict[str, np.ndarray]:
            p = np.array([model.score(t) for t in texts], dtype=float)
            return {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return run

    keep = [F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 5, 0).alias("held_out")]
    return map_texts(docs, keep, F.col(text_col), make, "score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labelled rows, then score every document."""
    return score(docs, fit(docs, labels))
