"""Near-duplicate documents by DartMinHash signatures of weighted shingles.

A document is the multiset of its five-word shingles; a shingle's weight is how often it occurs. Hashed darts fall at random on
the plane of weight and rank above each shingle, the same darts for every document; a document keeps those under its weight. Each
dart has one of K coordinates, and the earliest (lowest rank) in each coordinate is the signature's value there. Two documents
agree in a coordinate with a probability that is their weighted Jaccard similarity. Darts are thrown only up to the rank at
which all coordinates are expected to be hit, so the work is linear in shingles plus darts.

Signatures are cut into bands. Documents that share a band's hash are candidates; candidates are verified on their whole shingle
multisets. Texts of equal words are one class from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, scratch
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: Coordinates, and bands of ROWS coordinates each: two documents at SIMILARITY miss all bands with a probability of 4e-4.
ROWS, BANDS = 6, 26
K = ROWS * BANDS
#: Darts expected in all; one document in fifty leaves a coordinate empty and throws twice as many.
DARTS = K * (np.log(K) + 4)
#: Texts of a band that one block takes, in expectation.
BLOCK = 512
#: Candidate classes up to which hashes of their ids (8 bytes each) are broadcast to the documents; beyond that, the two are joined by a shuffle.
BROADCAST_CLASSES = 500_000
#: A band with more than 1 / HOT of all texts is hot. Each text is in BANDS bands, so there are at most BANDS * HOT of them, few enough to broadcast.
HOT = 1000
#: Bytes of shingle sets that a task holds for reuse.
HELD_BYTES = 64 << 20
_EMPTY = np.zeros(0, dtype=np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as reals from 0 to 1."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: The count of a Poisson variable of mean 1 exceeds k with probability _OVER[k].
_OVER = 1 - np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(18)])


def shingles(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A digest of the word sequence, and the distinct shingle hashes, ascending, with their counts.

    Words are parted by ASCII white space. A text of one to four words is one shingle; a text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    if not words:
        return digest, _EMPTY, _EMPTY
    known: dict[bytes, int] = {}
    at = np.array([known.setdefault(w, len(known)) for w in words])
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, known), dtype=np.uint64, count=len(known))[at]
    n = min(WORDS, len(own))
    h = np.full(len(own) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + own[k : len(own) - n + 1 + k])
    found, count = np.unique(h, return_counts=True)
    return digest, found, count.astype(np.uint64)


def darts(items: np.ndarray, weights: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ranks of the darts under `weights` with rank below `top`.

    The weight axis is cut into bands [2^v - 1, 2^(v+1) - 1); a cell is a band by 2^-v of rank, so its area is 1 and its number
    of darts is a Poisson variable of mean 1, drawn by the cell's hash.
    """
    hashes, ranks = [], []
    v = 0
    while len(items):
        cells = int(np.ceil(top * 2**v))
        seed = mix(items + np.uint64((v + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)))
        for low in range(0, cells, max(1, 4_000_000 // len(items))):
            m = np.arange(low, min(cells, low + max(1, 4_000_000 // len(items))), dtype=np.uint64)
            cell = mix(seed[:, None] + (m + np.uint64(1))[None, :] * np.uint64(0x9E3779B97F4A7C15))
            n = np.searchsorted(-_OVER, -unit(cell), side="left")
            i, j = np.nonzero(n)
            times = n[i, j]
            dart = np.repeat(cell[i, j], times)
            k = np.arange(len(dart)) - np.repeat(np.cumsum(times) - times, times)
            dart = mix(dart + (k + 1).astype(np.uint64) * _B)
            rank = (np.repeat(m[j], times) + unit(mix(dart ^ _A))) * 2.0**-v
            height = (2.0**v - 1) + unit(mix(dart ^ _B)) * 2.0**v
            under = (rank < top) & (height < np.repeat(weights[i], times))
            hashes.append(dart[under])
            ranks.append(rank[under])
        more = weights > 2.0 ** (v + 1) - 1
        items, weights, v = items[more], weights[more], v + 1
    return (np.concatenate(hashes), np.concatenate(ranks)) if hashes else (_EMPTY, np.zeros(0))


def signature(items: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The hash of the earliest dart in each of the K coordinates, of a document with at least one shingle."""
    top = DARTS / float(weights.sum())
    while True:
        dart, rank = darts(items, weights, top)
        order = np.argsort(-rank, kind="stable")
        out = np.zeros(K, dtype=np.uint64)
        full = np.zeros(K, dtype=bool)
        where = (dart[order] % np.uint64(K)).astype(np.int64)
        out[where] = dart[order]  # the last one written is the earliest
        full[where] = True
        if full.all():
            return out
        top *= 2


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of a signature; bands of different numbers differ."""
    grid = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum()) + int(b[1].sum()) - both, 1)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t1 and t2 (128 bits of the text), digest of the words, bands and sketch (a byte of each coordinate) for every row, without a shuffle; without words, no bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                made = [shingles(text) for text in part.column(3).to_pylist()]
                signatures = [signature(items, counts) if len(items) else None for _, items, counts in made]
                hashes = pa.array([None if g is None else bands(g).astype(np.int64) for g in signatures], type=pa.list_(pa.int64()))
                sketches = pa.array([None if g is None else (g >> np.uint64(40)).astype(np.uint8).tobytes() for g in signatures], type=pa.binary())
                columns = [*part.columns[:3], pa.array([m[0] for m in made], type=pa.binary()), hashes, sketches]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "t1", "t2", "digest", "bands", "sketch"])

    picked = docs.select(F.col(id_col).alias("id"), *text_hashes(F.col(text_col)), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, t1 long, t2 long, digest binary, bands array<long>, sketch binary")


def text_hashes(text: Column) -> list[Column]:
    """128 bits that stand for a text, as t1 and t2."""
    return [F.xxhash64(text.cast("string")).alias("t1"), F.xxhash64(F.lit("text"), text.cast("string")).alias("t2")]


def texts_of(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """digest and text, once each, of the classes in `needed` (digest and the id of a row that has it)."""
    # hashes are of one size whatever the ids are; what collides is sorted out by the digests
    wanted = needed.select(F.xxhash64("id").alias("wanted")).distinct()
    if needed.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.xxhash64(F.col(id_col)).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(wanted, F.col("id") == F.col("wanted"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.blake2b(b" ".join((t or "").encode("utf-8", "surrogatepass").split()), digest_size=16).digest() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, type=pa.binary()), batch.column(1)], names=["digest", "text"])

    digested = found.mapInArrow(run, "digest binary, text string")
    return digested.join(needed.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])


class Held:
    """Shingle multisets by digest, forgotten all at once when they exceed HELD_BYTES."""

    def __init__(self) -> None:
        self.sets: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.bytes = 0

    def get(self, digest: bytes, text: pa.StringScalar) -> tuple[np.ndarray, np.ndarray]:
        found = self.sets.get(digest)
        if found is None:
            found = shingles(text.as_py())[1:]
            if self.bytes > HELD_BYTES:
                self.sets, self.bytes = {}, 0
            self.sets[digest] = found
            self.bytes += found[0].nbytes + found[1].nbytes
        return found


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of classes with the verdict `linked`, from the whole shingle multisets of their texts."""
    one = texts.select(F.col("digest").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("digest").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            linked = []
            for a, b, ta, tb in zip(*(batch.column(k) for k in range(4)), strict=True):
                linked.append(similarity(held.get(a.as_py(), ta), held.get(b.as_py(), tb)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, type=pa.bool_())], names=["a", "b", "linked"])

    return both.mapInArrow(run, "a binary, b binary, linked boolean")


def _near(rows: pa.Table, agree: int) -> np.ndarray:
    """Pairs of rows (i, j, agreeing places) of different roots, within runs of equal (band, one, two), whose sketches agree in `agree` places.

    A pair is taken up in the first band that the two share.
    """
    n = rows.num_rows
    keys = np.column_stack([np.asarray(rows[c]) for c in ("band", "one", "two")])
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    block, number = np.asarray(rows["block"]), np.asarray(rows["no"])
    root = _numbered(rows["root"])
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), dtype=np.uint8).reshape(n, K)
    across = keys[:, 1] != keys[:, 2]  # of two blocks, only pairs between them
    at, step = np.arange(n), 1
    found = [np.zeros((0, 3), dtype=np.int64)]
    while len(at := at[at + step < end[at]]):
        some = at[(root[at] != root[at + step]) & (~across[at] | (block[at] != block[at + step]))]
        for low in range(0, len(some), 20_000):
            i = some[low : low + 20_000]
            same = sketch[i] == sketch[i + step]
            near = same.sum(1) >= agree
            i, same = i[near], same[near]
            first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == number[i]
            found.append(np.column_stack([i[first], i[first] + step, same[first].sum(1)]))
        step += 1
    return np.concatenate(found)


def _numbered(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests of 16 bytes as numbers from 0 on."""
    return np.unique(np.array(digests.to_pylist(), dtype="V16").view("S16"), return_inverse=True)[1]


def _links(rows: pa.Table, agree: int, least: float) -> pa.RecordBatch:
    """Links between different roots, from whole texts: enough of those within runs of equal (band, one, two) to span all that are similar."""
    pairs, root, digest = _near(rows, agree), _numbered(rows["root"]), rows["digest"].to_pylist()
    up = list(range(int(root.max(initial=-1)) + 1))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    held, a, b = Held(), [], []
    for i, j, _ in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y and similarity(held.get(digest[i], rows["text"][i]), held.get(digest[j], rows["text"][j])) >= least:
            up[x] = y
            a.append(digest[i])
            b.append(digest[j])
    return pa.RecordBatch.from_arrays([pa.array(a, type=pa.binary()), pa.array(b, type=pa.binary())], names=["a", "b"])


def _in_runs(dealt: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What `work` makes of whole runs of equal (band, one, two), which are the first columns and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([np.asarray(batch.column(k)) for k in range(3)])
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if held and tuple(keys[0]) != tuple(held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(3)):
                yield work(pa.Table.from_batches(held))
                held = []
            if len(changes):  # all runs but the last are whole
                yield work(pa.Table.from_batches([*held, batch.slice(0, int(changes[-1]))]))
                held = []
                batch = batch.slice(int(changes[-1]))
            held.append(batch)
        if held:
            yield work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def linked_in_blocks(left: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the roots of `left` (band, no, m, digest, root, sketch) wherever a band holds similar texts (digest, text).

    Bands are cut into blocks by hash, and pairs of blocks are compared within a task, so neither pairs nor whole bands come
    together. Blocks meet twice: first with sketches alone, which tell the members that resemble another one there; then these
    members bring their texts. Of a pair of similarity `least`, too few coordinates agree only with a chance of 3e-7.
    """
    agree = int(K * least - 5 * (K * least * (1 - least)) ** 0.5)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    cut = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "no", "digest", "root", "sketch")
    runs = lambda df: df.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")

    def near(rows: pa.Table) -> pa.RecordBatch:
        some = rows.take(pa.array(np.unique(_near(rows, agree)[:, :2]), type=pa.int64()))
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in some.columns], names=some.schema.names)

    alike = _in_runs(runs(cut), near, "band long, one int, two int, block int, no int, digest binary, root binary, sketch binary")
    full = alike.join(texts, "digest").select("band", "one", "two", "block", "no", "digest", "root", "sketch", "text")
    return _in_runs(runs(full), lambda rows: _links(rows, agree, least), "a binary, b binary")


def by_band(rows: DataFrame, bands_: DataFrame, hot: float) -> DataFrame:
    """`rows` with what `bands_` (band, m and more, one row each; m texts are in it) says of their bands; rows of other bands go.

    Hot bands are broadcast, so that their many rows stay where they are; all others are joined by a shuffle.
    """
    few = F.broadcast(bands_.filter(F.col("m") > hot))
    many = rows.join(few.select("band"), "band", "left_anti").join(bands_.filter(F.col("m") <= hot), "band")
    return rows.join(few, "band").unionByName(many)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """id, class_id (the smallest id of the class) and kept (id is class_id) for every row.

    A class is a component of links between texts whose shingle multisets have a weighted Jaccard similarity of `least` or more.
    First, every text is compared with three members of each of its bands (those first in three orders). Then
    all pairs that share a band but not yet a component are compared by signature, and those near enough by text, inside
    tasks that give on only the links found; so no candidate pair between components is left out.

    Null texts and texts without words belong to no class but that of their own id. Rows that repeat an id are in one class
    only if their texts are; each gets the smallest id of its class, and `kept` holds for all rows with that id. A null id
    counts as larger than all others. Other columns aren't read. An empty table gives no rows.
    """
    out = classed(docs, id_col, text_col, least)
    return out.select("id", "class_id", F.coalesce(F.col("id").eqNullSafe(F.col("class_id")), F.lit(False)).alias("kept"))


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """id, t1 and t2 (see text_hashes), root (names the class; null for a text without words) and class_id for every row; see near_duplicates."""
    rows = Settled(signed(docs, id_col, text_col), "minhash-rows").df
    # of a class of equal texts, one row goes on
    classes = Settled(rows.filter("bands is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "minhash-classes").df
    hot = max(classes.count() / HOT, BLOCK)
    banded = classes.select("digest", F.posexplode("bands").alias("no", "band"))
    shared = Settled(banded.groupBy("band").agg(F.count("*").alias("m"), F.min("digest").alias("l0"), F.min_by("digest", F.xxhash64("digest")).alias("l1"), F.max("digest").alias("l2")).filter("m > 1"), "minhash-bands")
    members = Settled(by_band(banded, shared.df, hot), "minhash-members")
    shared.drop()
    leaders = members.df.select("digest", F.explode(F.array("l0", "l1", "l2")).alias("leader")).filter("digest <> leader")
    pairs = Settled(leaders.select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")).distinct(), "minhash-pairs")
    needed = Settled(classes.select("digest", "id").join(members.df.select("digest").distinct(), "digest", "left_semi"), "minhash-needed")
    texts = Settled(texts_of(docs, needed.df, id_col, text_col), "minhash-texts")
    first = Settled(verified(pairs.df, texts.df, least), "minhash-verified")
    with scratch() as kept:
        roots = Settled(components(first.df.filter("linked")), "minhash-roots")
        kept.append(roots)
    for done in (pairs, needed, first):
        done.drop()
    # bands whose members are still in several components
    placed = members.df.select("band", "no", "digest", "m").join(roots.df.withColumnRenamed("node", "digest"), "digest", "left").select("band", "no", "digest", "m", F.coalesce("root", "digest").alias("root"))
    placed = Settled(placed, "minhash-placed")
    apart = placed.df.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.first("m").alias("m")).filter("r0 <> r1").select("band", "m")
    left = by_band(placed.df.drop("m"), apart, hot).join(classes.select("digest", "sketch"), "digest")
    second = Settled(linked_in_blocks(left, texts.df, least), "minhash-links")
    links = roots.df.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(second.df)
    final = components(links)
    for done in (members, texts, roots, placed, second):
        done.drop()
    named = classes.select("digest", "id").join(final.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "id", F.coalesce("root", "digest").alias("root"))
    top = named.groupBy("root").agg(F.min("id").alias("class_id"))
    grouped = named.join(top, "root").select("digest", "root", "class_id")
    out = rows.select("id", "t1", "t2", "digest", F.col("bands").isNotNull().alias("worded")).join(grouped, "digest", "left")
    return out.select("id", "t1", "t2", F.when(F.col("worded"), F.col("root")).alias("root"), F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
