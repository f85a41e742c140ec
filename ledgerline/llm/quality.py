"""Quality rules with an isolation forest over the rules' statistics.

Each text gives rule statistics: words, their characters, symbols, repeated lines and repeated words. Rules reject texts outright
(`base_failed`). Of the others, an isolation forest tells which are anomalous: random splits of the statistics' space, taken as shares and
means so that length alone says little, isolate unusual rows on short paths. All labelled rows count: half are dealt to the trees, which
grow on the executors, and the other half, which the forest hasn't seen, calibrate the score above which a row is anomalous. Poor rows widen the range
that splits are drawn from, but good rows alone count in the leaves, so where poor rows lie paths are short, however many there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, map_texts, scratch, seed_of

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Trees (a power of two), and rows that a tree has at least where there are as many: each row goes to as many trees as that takes, and to one at least.
TREES, TREE_ROWS = 128, 256
#: At most this share of labelled good rows may lie above the threshold.
FALSE_ALARMS = 0.002
#: Decimals of an anomaly: labelled rows are counted by it, so the driver holds 10^5 counts of either label at most.
DECIMALS = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest splits: symbols per character and per word, characters per word, repetition of lines and words, and length.
FEATURES = ["f_symbols", "f_word_symbols", "f_word_chars", "f_repeats", "f_words"]
#: Words, characters and lines that each share and mean is shrunk by, so that short texts don't stand out by chance.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_WORD_CHARS, PRIOR_LINES = 30, 150, 5, 3

STATS = ", ".join([f"{c} long" for c in COUNTS] + [f"{f} double" for f in FEATURES])


def text_stats(text: str | None) -> tuple[int, int, int, int, int, float, float, float, float, float]:
    """COUNTS and, made of them, FEATURES of one text; null counts as a text without words."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()  # at ASCII white space
    n = len(words)
    chars = len(text or "") - (len(b) - len(b.translate(None, _SPACE)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in b.split(b"\n"):
        if line in seen:
            dup += 1
            lines += 1
        elif line.strip():
            seen.add(line)
            lines += 1
    repeat = 0
    if n > WINDOW:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeat += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    repeats = dup / (lines + PRIOR_LINES) + repeat / (n + PRIOR_WORDS)
    mean = (chars + PRIOR_WORD_CHARS * PRIOR_WORDS) / (n + PRIOR_WORDS)
    return n, chars, symbols, dup, repeat, symbols / (chars + PRIOR_CHARS), symbols / (n + PRIOR_WORDS), mean, repeats, math.log1p(n)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def stats_columns(texts: list[str | None]) -> dict[str, np.ndarray]:
    """COUNTS and FEATURES of many texts."""
    columns = zip(*map(text_stats, texts), strict=True) if texts else [()] * len(COUNTS + FEATURES)
    return {c: np.array(v, dtype="int64" if c in COUNTS else "float64") for c, v in zip(COUNTS + FEATURES, columns, strict=True)}


@dataclass
class Forest:
    """Trees as arrays: node k of tree t splits feature[t, k] at cut[t, k] into nodes 2k+1 and 2k+2; leaves give path lengths."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    depth: int
    rows: float
    threshold: float | None = 1.0

    @staticmethod
    def mean_path(n: np.ndarray | float) -> np.ndarray:
        """Mean length of an unsuccessful search in a binary search tree of n rows."""
        n = np.asarray(n, dtype=float)
        m = np.maximum(n, 2)
        return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m))

    @classmethod
    def grow(cls, x: np.ndarray, seed: int) -> Forest:
        """A forest of rows at hand, TREE_ROWS of them drawn for each tree."""
        rng = np.random.default_rng(seed)
        rows = min(TREE_ROWS, len(x))
        depth = cls.depth_of(rows)
        trees = [cls.tree(x[rng.permutation(len(x))[:rows]], np.ones(rows), depth, rng) for _ in range(TREES)]
        return cls(*(np.stack(a) for a in zip(*trees, strict=True)), depth, rows)

    @staticmethod
    def depth_of(rows: float) -> int:
        return int(np.ceil(np.log2(max(min(rows, TREE_ROWS), 2))))

    @classmethod
    def tree(cls, x: np.ndarray, weight: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """feature, cut and length of the nodes of one tree of all rows of x; a leaf counts as many rows as its rows weigh."""
        nodes = 2 ** (depth + 1) - 1
        feature, cut, length = np.full(nodes, -1, dtype=np.int64), np.zeros(nodes), np.zeros(nodes)
        todo = [(0, 0, x, weight)]
        while todo:
            k, d, part, w = todo.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
            able = np.flatnonzero(high > low)
            if d == depth or w.sum() <= 1 or not len(able):
                length[k] = d + cls.mean_path(w.sum())
                continue
            f = int(rng.choice(able))
            c = rng.uniform(low[f], high[f])
            feature[k], cut[k] = f, c
            left = part[:, f] < c
            todo += [(2 * k + 1, d + 1, part[left], w[left]), (2 * k + 2, d + 1, part[~left], w[~left])]
        return feature, cut, length

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1; short mean paths score high."""
        total = np.zeros(len(x))
        at = np.arange(len(x))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            k = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[k]
                inner = f >= 0
                k = np.where(inner, 2 * k + 1 + (x[at, np.maximum(f, 0)] >= cut[k]), k)
            total += length[k]
        return 2.0 ** (-total / TREES / max(float(self.mean_path(self.rows)), 1e-9))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, two hashes of the text, COUNTS and FEATURES of every row."""
    text = F.col(text_col).cast("string")
    keep = [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]
    return map_texts(docs, keep, text, lambda: stats_columns, STATS)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """The forest of all labelled rows of `docs`, as of their statistics."""
    return fit_measured(measured(docs, id_col, text_col), labels, id_col, label_col)


def fit_measured(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Forest:
    """Grow a forest on about half of the labelled rows and calibrate its threshold on all others.

    Hashed ids tell the halves and the trees that a row is dealt to, so nothing depends on the order or partitioning of the input; of rows
    that share an id one counts, that of the smallest hashed text, and rows that fail the base rules don't. A tree holds its own rows in one task: TREE_ROWS or,
    if that is more, a part in TREES of all. The threshold is the score that best parts good from bad rows, among those that at most FALSE_ALARMS of
    the good ones exceed. Without good labelled rows the forest has one leaf and rejects nothing.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    )
    one = (
        stats.join(known, F.col("doc_id") == F.col("id"))
        .groupBy("id", "y").agg(F.min_by(F.struct("n_words", "n_repeat_words", *FEATURES), F.struct("h1", "h2")).alias("s")).select("id", "y", "s.*")
        .filter(~base_failed())
    )
    fold = (F.crc32(F.concat(F.lit("forest|"), F.col("id").cast("string")).cast("binary")) % 2).cast("int")
    with scratch():
        rows = Settled(one.select("id", F.when(F.col("y") == 1, 1).otherwise(0).alias("y"), fold.alias("fold"), *FEATURES), "quality-labelled").df
        forest = grown(rows.filter("fold = 0"))
        if forest.threshold is None:
            forest.threshold = calibrated(*graded(rows.filter("fold = 1"), forest))
    return forest


def grown(rows: DataFrame) -> Forest:
    """The forest of rows (id, y, FEATURES), its threshold open; a leaf that rejects nothing if there is no good row."""
    good = rows.filter("y = 1").count()
    if not good:
        return Forest.grow(np.zeros((1, len(FEATURES))), 0)
    trees = min(TREES, math.ceil(TREES * TREE_ROWS / good))
    size = good * trees / TREES
    depth = Forest.depth_of(size)

    def grow(key: tuple[int], part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", *FEATURES])
        made = Forest.tree(part[FEATURES].to_numpy(), part["y"].to_numpy(dtype=float), depth, np.random.default_rng([seed_of("quality"), key[0]]))
        return pd.DataFrame({"tree": key[0], "feature": [made[0]], "cut": [made[1]], "length": [made[2]]})

    first, step = F.pmod(F.xxhash64(F.lit("tree"), "id"), F.lit(TREES)), F.pmod(F.xxhash64(F.lit("step"), "id"), F.lit(TREES)) * 2 + 1
    dealt = rows.withColumn("tree", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda j: ((first + j * step) % TREES).cast("int"))))
    made = dealt.groupBy("tree").applyInPandas(grow, "tree int, feature array<long>, cut array<double>, length array<double>").orderBy("tree").collect()
    return Forest(*(np.array([r[c] for r in made]) for c in ("feature", "cut", "length")), depth, size, None)


def graded(rows: DataFrame, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anomalies of rows (y, FEATURES) to DECIMALS, whether they are of good rows, and how many such rows there are."""
    scored = rows.select("y", *FEATURES).mapInArrow(_scorer(rows, forest), "y int, anomaly double")
    counts = scored.groupBy("anomaly", "y").agg(F.count("*").alias("n")).orderBy("anomaly", "y").toPandas()
    return counts["anomaly"].to_numpy(dtype=float), counts["y"].to_numpy() == 1, counts["n"].to_numpy(dtype=np.int64)


def _scorer(rows: DataFrame, forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What puts an anomaly in the place of the FEATURES of rows, which are their last columns."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anomaly = np.round(shared.value.score(np.column_stack([b.column(f).to_numpy() for f in FEATURES])), DECIMALS)
            names = b.schema.names[: -len(FEATURES)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(anomaly)], names=[*names, "anomaly"])

    return run


def calibrated(scores: np.ndarray, good: np.ndarray, n: np.ndarray | None = None) -> float:
    """Of the scores (n rows of each, or one) that at most FALSE_ALARMS of the good rows exceed, the one that parts good and bad best; 1 if there is none."""
    n = np.ones(len(scores), dtype=np.int64) if n is None else n
    at, place = np.unique(scores, return_inverse=True)

    def exceed(those: np.ndarray) -> np.ndarray:
        upto = np.cumsum(np.bincount(place, weights=n * those, minlength=len(at)))
        return (upto[-1] - upto) / upto[-1] if len(upto) and upto[-1] else np.zeros(len(at))

    alarms, caught = exceed(good), exceed(~good)
    allowed = np.flatnonzero(alarms <= FALSE_ALARMS)
    return float(at[allowed[np.argmax(caught[allowed] - alarms[allowed])]]) if len(allowed) else 1.0


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict for every row: doc_id, COUNTS, base_failed, anomaly (0 to 1), kept.

    Null and empty texts have no words and fail the base rules. Repeated rows get a row each. Equal scores get equal verdicts;
    a score that equals the threshold is kept. Other columns are not read. An empty table gives no rows.
    """
    return judge_measured(measured(docs, id_col, text_col), forest)


def judge_measured(stats: DataFrame, forest: Forest) -> DataFrame:
    own = stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), *FEATURES)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: -len(FEATURES)])
    scored = own.mapInArrow(_scorer(own, forest), f"{fields}, anomaly double")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= forest.threshold))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measure every document once, fit on all labelled ones, then judge all."""
    stats = Settled(measured(docs), "quality-stats").df
    return judge_measured(stats, fit_measured(stats, labels))
