"""Removal of long byte strings that stand in several places, by bounded interval expansion on Burrows-Wheeler transforms.

A string of MIN_BYTES that stands twice holds the same anchor in both places: the gram of least hash of all that it holds. So texts are
scanned for anchors, and only what lies around anchors whose hash occurs again (their contexts) is compared, in blocks of bounded size: contexts with
one anchor are in one block. A block sorts its suffixes, forms the Burrows-Wheeler transform and extends strings backwards,
breadth first: the places where neighbouring suffixes part come out by increasing length of what they share. At MIN_BYTES it stops:
neighbours that haven't parted by then share a string of that length.

Contexts that are equal stand for each other, so a passage copied many times is compared once. An anchor whose contexts are too many for a block
is split by what its strings must share: strings that hold the anchor at an offset from o1 to o2 all hold the bytes from the last start to the first end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Settled, free_name, scratch

#: Strings of so many bytes that start in two places go.
MIN_BYTES = 400
#: Bytes of an anchor.
GRAM = 64
#: Bytes that a block sorts, in expectation, and contexts of one anchor beyond which it is split, by ever fewer offsets.
BLOCK, HOT, WIDTHS = 1 << 20, 4000, (85, 15, 3, 1)
#: Bytes of a text that are scanned at once; positions in a slice must fit into 24 bits.
SLICE = 1 << 22
_REACH = MIN_BYTES - GRAM
_BYTE = np.random.default_rng(20240311).integers(0, 2**64, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFF)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of GRAM bytes, made of those of half as many."""
    h, m = _BYTE[b], 1
    while m < GRAM:
        h = h[:-m] * np.uint64(0x9E3779B97F4A7C15) + (h[m:] ^ (h[m:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        m *= 2
    return h


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors: the gram of least hash, the first of equals, of every string of MIN_BYTES."""
    positions, hashes, w = [], [], _REACH + 1
    for low in range(0, len(text) - MIN_BYTES + 1, SLICE):
        h = _gram_hashes(np.frombuffer(text, np.uint8, min(SLICE + MIN_BYTES - 1, len(text) - low), low))
        ordered = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        padded = np.append(ordered, np.full(-len(h) % w, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
        ahead, behind = np.minimum.accumulate(padded, 1).ravel(), np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        least = (np.minimum(behind[: len(h) - w + 1], ahead[w - 1 : len(h)]) & _LOW).astype(np.int64)
        least = least[np.append(True, least[1:] != least[:-1])]
        positions.append(least + low)
        hashes.append(h[least].view(np.int64))
    if not positions:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, first = np.unique(np.concatenate(positions), return_index=True)
    return at, np.concatenate(hashes)[first]


_ANCHORS = "t1 long, t2 long, pos long, lo long, hi long, h long, c1 long, c2 long"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of texts (t1, t2, text), each with its context from lo to hi and 128 bits that stand for that and the anchor's place in it."""
    for batch in batches:
        t1, t2, texts = (batch.column(k) for k in range(3))
        row, made, digests = [], [], []
        for i in range(batch.num_rows):
            raw = texts[i].as_buffer().to_pybytes()
            at, h = anchors(raw)
            lo, hi = np.maximum(at - _REACH, 0), np.minimum(at + MIN_BYTES, len(raw))
            view = memoryview(raw)
            digests += [xxhash.xxh3_128_digest(view[a:b], p - a) for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            row.append(np.full(len(at), i))
            made.append(np.array([at, lo, hi, h]))
        if not digests:
            continue
        c = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        rows, parts = pa.array(np.concatenate(row)), np.concatenate(made, axis=1)
        yield pa.RecordBatch.from_arrays([t1.take(rows), t2.take(rows), *map(pa.array, parts), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], names=["t1", "t2", "pos", "lo", "hi", "h", "c1", "c2"])


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of `codes` (small numbers) in order of their first `depth` entries at least, by doubling; ties stand in any order."""
    n, seen = len(codes), 7
    first = np.zeros(n, np.int64)
    for k in range(seen):
        first = first << 9
        first[: n - k] |= codes[k:]
    order = np.argsort(first)
    rank = np.zeros(n + 1, np.int64)
    open_ = np.arange(n)
    keys = first[order]
    while True:
        parted = np.append(True, keys[1:] != keys[:-1])
        rank[order[open_]] = np.maximum.accumulate(np.where(parted, open_, 0)) + 1
        several = ~(parted & np.append(parted[1:], True))
        open_ = open_[several]
        if seen >= depth or not len(open_):
            return order
        own = order[open_]
        keys = rank[own] * (n + 2) + rank[np.minimum(own + seen, n)]
        by = np.argsort(keys)
        order[open_], keys = own[by], keys[by]
        seen *= 2


def unparted(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in `order` shares its first `depth` entries with the one before it; the first doesn't.

    Breadth-first extension: a place where neighbours part after k entries gives, for each entry that precedes suffixes on
    either side of it, a place where neighbours part after k + 1. So all places come out by increasing k, each once.
    """
    n = len(codes)
    last = codes[order - 1]  # the transform: what precedes each suffix
    back = np.argsort(last, kind="stable")  # where a suffix without its first entry stands
    step = np.empty(n, np.int64)  # where a suffix with what precedes it stands
    step[back] = np.arange(n)
    head = last[back]
    parted = np.zeros(n + 1, bool)
    parted[0] = parted[n] = True
    parted[1:n] = head[1:] != head[:-1]
    runs = np.append(np.flatnonzero(np.append(True, last[1:] != last[:-1])), n)
    new = np.flatnonzero(parted)
    for _ in range(1, depth):
        if not len(new):
            break
        if len(new) > n // 64:  # many at once: look at all neighbours
            owner = np.cumsum(parted[:n])[back]
            fresh = np.flatnonzero((owner[1:] != owner[:-1]) & ~parted[1:n]) + 1
        else:
            ends = np.flatnonzero(parted)
            k = np.searchsorted(ends, new)
            inner = (new > 0) & (new < n)
            b, before, after = new[inner], ends[k[inner] - 1], ends[np.minimum(k[inner] + 1, len(ends) - 1)]
            fresh = np.concatenate([step[_firsts(b, after, runs, last)], step[_lasts(before, b, runs, last)] + 1])
            fresh = np.unique(fresh[~parted[fresh]])
        parted[fresh] = True
        new = fresh
    return ~parted[:n]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from each low to below its high, and whose they are."""
    size = high - low
    whose = np.repeat(np.arange(len(low)), size)
    return np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size) + low[whose], whose


def _within(low: np.ndarray, high: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts of runs inside each interval but not at its start, and whose they are."""
    at, whose = _spread(np.searchsorted(runs, low, "right"), np.searchsorted(runs, high, "left"))
    return runs[at], whose


def _ordered(at: np.ndarray, whose: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of interval, entry of `last` and place, and a number for the first two."""
    key = ((whose * 512 + last[at]) << 32) + at
    key.sort()
    return key & 0xFFFFFFFF, key >> 32


def _firsts(low: np.ndarray, high: np.ndarray, runs: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each interval, where each entry of `last` first stands in it; that is at the interval's start or where a run starts."""
    at, whose = _within(low, high, runs)
    at, of = _ordered(np.concatenate([low, at]), np.concatenate([np.arange(len(low)), whose]), last)
    return at[np.append(True, of[1:] != of[:-1])] if len(at) else at


def _lasts(low: np.ndarray, high: np.ndarray, runs: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each interval, where each entry of `last` last stands in it; that is at the interval's end or where a run ends."""
    at, whose = _within(low, high, runs)
    at, of = _ordered(np.concatenate([high - 1, at - 1]), np.concatenate([np.arange(len(low)), whose]), last)
    return at[np.append(of[1:] != of[:-1], True)] if len(at) else at


def repeated_starts(pieces: list[bytes], places: list[int]) -> list[np.ndarray]:
    """Where in each piece a string of MIN_BYTES starts that also starts at another place; places: where the pieces start, in one count over all texts."""
    codes = np.zeros(sum(map(len, pieces)) + len(pieces), np.int16)
    room, place = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    begins, low = [], 0
    for p, where in zip(pieces, places, strict=True):
        codes[low : low + len(p)] = np.frombuffer(p, np.uint8)
        codes[low : low + len(p)] += 1  # 0 ends a piece
        room[low : low + len(p)] = np.arange(len(p), 0, -1)
        place[low : low + len(p)] = np.arange(where, where + len(p))
        begins.append(low)
        low += len(p) + 1
    order = suffix_order(codes, MIN_BYTES)
    alike = unparted(codes, order, MIN_BYTES)
    # groups of suffixes that share a string; overlapping pieces of a text may hold one place twice, which is no repeat
    start = np.flatnonzero(~alike)
    where = place[order]
    real = np.minimum.reduceat(where, start) != np.maximum.reduceat(where, start)
    good = np.zeros(len(codes), bool)
    good[order] = np.repeat(real, np.diff(np.append(start, len(codes))))
    good &= room >= MIN_BYTES
    return [np.flatnonzero(good[a : a + len(p)]) for a, p in zip(begins, pieces, strict=True)]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts, those that touch or overlap as one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    gap = starts[1:] > reach[:-1]
    return starts[np.append(True, gap)], reach[np.append(gap, True)]


_SPANS = "array<struct<a: long, b: long>>"
_CONTEXT = "struct<h: long, c1: long, c2: long, pos: long, lo: long, hi: long>"


def _spans(found: np.ndarray, pos: int) -> list[dict]:
    a, b = merged(found, found + MIN_BYTES)
    return [{"a": x - pos, "b": y - pos} for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _block(group: pa.Table) -> pa.Table:
    """What of each context of a block stands elsewhere in it: spans relative to the anchor. Pieces that come twice count once."""
    seen, numbers, pieces, places, rows = set(), {}, [], [], []
    for r in group.select(["t1", "t2", "start", "piece", "contexts"]).to_pylist():
        if (key := (r["t1"], r["t2"], r["start"], len(r["piece"]))) not in seen:
            seen.add(key)
            rows.append(r)
            pieces.append(r["piece"])
            places.append(numbers.setdefault(key[:2], len(numbers) << 40) + r["start"])
    out: dict[str, list] = {"h": [], "c1": [], "c2": [], "spans": []}
    for r, starts in zip(rows, repeated_starts(pieces, places), strict=True):
        at = starts + r["start"]
        for c in r["contexts"]:
            own = at[np.searchsorted(at, c["lo"]) : np.searchsorted(at, c["hi"] - MIN_BYTES, "right")]
            if len(own):
                for k in ("h", "c1", "c2"):
                    out[k].append(c[k])
                out["spans"].append(_spans(own, c["pos"]))
    spans = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.table([pa.array(out[k], pa.int64()) for k in ("h", "c1", "c2")] + [pa.array(out["spans"], spans)], names=["h", "c1", "c2", "spans"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut texts (t1, t2, text, wanted: contexts with their block) into what each block needs of them; contexts that overlap are one piece.

    Copies of a text stand one after another, and only the first is cut.
    """
    contexts = pa.list_(pa.struct([(k, pa.int64()) for k in ("h", "c1", "c2", "pos", "lo", "hi")]))
    names, before = ["block", "hot", "t1", "t2", "start", "piece", "contexts"], None
    for batch in batches:
        out: dict[str, list] = {k: [] for k in names}
        for i in range(batch.num_rows):
            key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            if key == before:
                continue
            before, raw = key, batch.column(2)[i].as_buffer().to_pybytes()
            piece: list[dict] = []
            wanted = sorted(batch.column(3)[i].as_py(), key=lambda c: (c["hot"], c["block"], c["lo"], c["hi"]))
            for k, c in enumerate(wanted):
                piece.append(c)
                after = wanted[k + 1] if k + 1 < len(wanted) else None
                if after is None or c["hot"] or after["block"] != c["block"] or after["lo"] >= c["hi"]:
                    lo, hi = piece[0]["lo"], c["hi"]
                    for name, value in zip(names, (c["block"], c["hot"], *key, lo, raw[lo:hi], piece), strict=True):
                        out[name].append(value)
                    piece = []
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), contexts]
        yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types, strict=True)], names=names)


_PIECES = f"block long, hot boolean, t1 long, t2 long, start long, piece binary, contexts array<{_CONTEXT}>"


def _cut(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """The pieces of texts around `contexts` (block, hot, t1, t2, h, c1, c2, pos, lo, hi); a hot one is a piece of its own."""
    wanted = contexts.groupBy("t1", "t2").agg(F.collect_list(F.struct("block", "hot", "h", "c1", "c2", "pos", "lo", "hi")).alias("wanted"))
    return texts.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted").mapInArrow(_pieces, _PIECES)


def _compared(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("block").applyInArrow(_block, f"h long, c1 long, c2 long, spans {_SPANS}")


def _grouped(items: DataFrame) -> DataFrame:
    """h, c1, c2, n and r (the first of those) for all equal contexts of anchors that occur twice, with n_distinct and label (the smallest text) of the anchor."""
    place = F.struct("t1", "t2", "pos", "lo", "hi")
    contexts = Settled(items.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("r")).select("h", "c1", "c2", "n", "r.*"), "repeat-distinct").df
    groups = contexts.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("n_distinct"), F.min("t1").alias("label")).filter("total > 1")
    groups = Settled(groups.drop("total"), "repeat-anchor-groups").df
    # too common anchors are broadcast, one row for more than HOT contexts each, so that these stay where they are; others meet their contexts by a shuffle
    common = F.broadcast(groups.filter(F.col("n_distinct") > HOT).select(F.col("h").alias("_h"), "n_distinct", "label"))
    marked = contexts.join(common, F.col("h") == F.col("_h"), "left")
    rest = marked.filter("_h IS NULL").select(*contexts.columns).join(groups.filter(F.col("n_distinct") <= HOT), "h")
    names = [*contexts.columns, "n_distinct", "label"]
    return marked.filter("_h IS NOT NULL").select(*names).unionByName(rest.select(*names))


def _whole(contexts: DataFrame) -> DataFrame:
    """Contexts that stand in several places as they are."""
    span = F.struct((F.col("lo") - F.col("pos")).alias("a"), (F.col("hi") - F.col("pos")).alias("b"))
    return contexts.filter("n > 1").select("h", "c1", "c2", F.array(span).alias("spans"))


def _blocked(contexts: DataFrame) -> DataFrame:
    """Contexts with their block: anchors of one label share a block, or as many as their bytes ask for; small labels share blocks."""
    sizes = contexts.groupBy("label").agg(F.sum(F.col("hi") - F.col("lo")).alias("size"))
    # contexts of a text overlap, so that a block's pieces have about half of their bytes
    bins = (sizes.agg(F.sum("size")).first()[0] or 0) // (2 * BLOCK) + 1
    parts = F.ceil(F.col("size") / (2 * BLOCK)).cast("int")
    block = F.when(parts <= 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.xxhash64("label", F.pmod(F.xxhash64(F.lit("part"), "h"), parts)))
    return contexts.join(sizes, "label").select(block.alias("block"), "t1", "t2", "h", "c1", "c2", "pos", "lo", "hi")


def _narrowed(items: DataFrame, width: int) -> DataFrame:
    """The contexts of too common anchors, cut for `width` offsets of the anchor each and grouped by what strings at these offsets share.

    items: h, c1 and c2 of the context, key, o1 and o2 (the offsets), t1, t2, pos, lo, and piece (its bytes from lo). Of the bytes, only
    hashes go on: key stands for what is shared, k1 and k2 for the part of the context that these offsets reach.
    """
    each = items.withColumn("o1", F.explode(F.sequence(F.col("o1"), F.col("o2"), F.lit(width)))).withColumn("o2", F.least(F.col("o1") + width - 1, "o2"))
    end = F.col("lo") + F.octet_length("piece")
    each = each.filter((F.col("pos") - F.col("o1") >= F.col("lo")) & (F.col("pos") - F.col("o2") + MIN_BYTES <= end))
    cut = lambda a, b: F.substring(F.col("piece"), (a - F.col("lo") + 1).cast("int"), (b - a).cast("int"))
    shared = cut(F.col("pos") - F.col("o1"), F.col("pos") - F.col("o2") + MIN_BYTES)
    lo = F.greatest(F.col("lo"), F.col("pos") - F.col("o2"))
    hi = F.least(end, F.col("pos") - F.col("o1") + MIN_BYTES)
    own, left = cut(lo, hi), F.col("pos") - lo
    hashes = [F.xxhash64(left, own).alias("k1"), F.xxhash64(F.lit("context"), left, own).alias("k2")]
    return each.select("h", "c1", "c2", F.xxhash64("key", "o1", shared).alias("key"), "o1", "o2", "t1", "t2", "pos", lo.alias("lo"), hi.alias("hi"), *hashes)


def _hot(pieces: DataFrame) -> list[DataFrame]:
    """Spans of the contexts of anchors that have more than HOT, by ever narrower offsets; at single offsets equal parts are equal strings."""
    one = F.element_at("contexts", 1)
    items = pieces.select(one["h"].alias("h"), one["c1"].alias("c1"), one["c2"].alias("c2"), "t1", "t2", one["pos"].alias("pos"), F.col("start").alias("lo"), "piece")
    items = Settled(items.dropDuplicates(["h", "c1", "c2"]), "repeat-hot").df  # a text that comes several times may have been cut as often
    active = items.select("*", F.col("h").alias("key"), F.lit(0).cast("long").alias("o1"), F.lit(_REACH).cast("long").alias("o2"))
    found = []
    for width in WIDTHS:
        narrow = Settled(_narrowed(active, width), "repeat-narrow").df
        grouped = Settled(_grouped(narrow.select(F.col("key").alias("h"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), "t1", "t2", "pos", "lo", "hi")), "repeat-narrow-groups").df
        open_ = grouped.filter((F.col("n_distinct") > 1) & (F.col("n_distinct") <= HOT))
        first = _blocked(open_).join(items.select("t1", "t2", "pos", F.col("lo").alias("low"), "piece"), ["t1", "t2", "pos"])
        bytes_ = F.substring(F.col("piece"), (F.col("lo") - F.col("low") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
        pieces = first.select("block", "t1", "t2", F.col("lo").alias("start"), bytes_.alias("piece"), F.array(F.struct("h", "c1", "c2", "pos", "lo", "hi")).alias("contexts"))
        spans = _whole(grouped).unionAll(_compared(pieces)).withColumnsRenamed({"h": "key", "c1": "k1", "c2": "k2"})
        found.append(narrow.join(spans, ["key", "k1", "k2"]).select("h", "c1", "c2", "spans"))
        more = grouped.filter(F.col("n_distinct") > HOT).select(F.col("h").alias("key")).distinct()
        if width == WIDTHS[-1] or more.isEmpty():
            return found
        ranges = narrow.join(more, "key", "left_semi").select("h", "c1", "c2", "key", "o1", "o2")
        active = items.join(ranges, ["h", "c1", "c2"])
    return found


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def find_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """t1, t2 (hashes of a text) and spans (from a to below b, in bytes, many and overlapping) of what stands in several places, for texts that have such.

    A text that comes several times counts as often. Null texts and those of less than MIN_BYTES bytes have none.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(*text_key(text), text.cast("binary").alias("text")).filter(F.octet_length("text") >= MIN_BYTES)
    found = Settled(texts.mapInArrow(_anchored, _ANCHORS), "repeat-anchors").df
    live = Settled(_grouped(found), "repeat-contexts").df
    open_ = live.filter(F.col("n_distinct") > 1)
    few, many = open_.filter(F.col("n_distinct") <= HOT), open_.filter(F.col("n_distinct") > HOT)
    blocked = _blocked(few).withColumn("hot", F.lit(False))
    alone = many.select(F.xxhash64("h", "c1", "c2").alias("block"), *blocked.columns[1:-1]).withColumn("hot", F.lit(True))
    # texts are shuffled once for both
    pieces = Settled(_cut(texts, blocked.unionByName(alone)), "repeat-pieces").df
    parts = [_whole(live), _compared(pieces.filter("NOT hot"))]
    if not many.isEmpty():
        parts += _hot(pieces.filter("hot"))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionAll(p)
    spans = Settled(spans.groupBy("h", "c1", "c2").agg(F.flatten(F.collect_set("spans")).alias("spans")), "repeat-spans").df
    placed = found.join(spans, ["h", "c1", "c2"]).dropDuplicates(["t1", "t2", "pos"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("pos")).alias("a"), (s["b"] + F.col("pos")).alias("b")))
    return placed.groupBy("t1", "t2").agg(F.flatten(F.collect_list(moved)).alias("spans"))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each row with what is left of its text (the last column but one) without the spans (the last)."""
    for batch in (b.slice(low, 512) for b in batches for low in range(0, b.num_rows, 512)):
        size, removed, n_spans, kept = [], [], [], []
        texts, spans = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        for i in range(batch.num_rows):
            raw = b"" if not texts[i].is_valid else texts[i].as_buffer().to_pybytes()
            size.append(len(raw))
            if not spans[i].is_valid:
                removed.append(0), n_spans.append(0), kept.append(raw)
                continue
            flat = spans[i].values
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            by = np.argsort(a)
            a, b = merged(a[by], b[by])
            removed.append(int((b - a).sum())), n_spans.append(len(a))
            kept.append(b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True)))
        made = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.large_binary()).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=[*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, without the text but with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that remain, which may not be whole characters).

    Each byte goes that a string of MIN_BYTES covers which also starts elsewhere, in the same text or another; strings never cross texts and are
    judged on the input. So all copies of a long text go, the first too. A null text counts as empty; repeated rows and texts are copies of each
    other. Columns named like those made here give way to them; others are kept untouched. An empty table gives no rows.
    """
    with scratch() as kept:
        found = Settled(find_repeats(docs, text_col), "repeats")
        kept.append(found)
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    own = [c for c in docs.columns if c != text_col and c.lower() not in made]
    text = F.col(f"`{text_col}`").cast("string")
    k1, k2 = free_name(docs, "_t1"), free_name(docs, "_t2")
    hashes = text_key(F.coalesce(text, F.lit("")))
    keyed = docs.select(*[F.col(f"`{c}`") for c in own], text.cast("binary").alias(free_name(docs, "_text")), hashes[0].alias(k1), hashes[1].alias(k2))
    joined = keyed.join(found.df.withColumnsRenamed({"t1": "_f1", "t2": "_f2", "spans": "_spans"}), (F.col(k1) == F.col("_f1")) & (F.col(k2) == F.col("_f2")), "left")
    picked = joined.select(*[F.col(f"`{c}`") for c in own], F.col(free_name(docs, "_text")), F.col("_spans"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-2])
    return picked.mapInArrow(_rest, f"{types}{', ' if own else ''}n_bytes long, n_removed long, n_spans long, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
