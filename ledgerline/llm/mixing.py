"""Mixing of sources to target weights by balanced sampling with the cube method.

Every source's target over its size says how often its documents are taken: the whole part goes to all of them, the fraction is
each document's inclusion probability. In the flight phase, the probabilities move through the null space of two constraints,
the number of documents and the number of words taken, until all but two of a block are 0 or 1. Sources are cut into blocks of
bounded size; what blocks leave open is gathered by source and flown again, until one block of a source is left, which lands.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Settled, n_words, scratch, seed_of

WEIGHTS = (5, 2, 1)
#: Words the whole mix takes over words there are, and the most a source may be repeated.
TOTAL, MOST = 1.5, 2.0
BLOCK_ROWS = 4096
#: Sources up to which their table is broadcast, with names of NAME_BYTES on average at most; beyond that, it is joined by a shuffle.
BROADCAST_SOURCES, NAME_BYTES = 20_000, 200


def numbered(per: DataFrame) -> DataFrame:
    """`per` (one row for each source) with `rank`, the place of each source in code point order from 0 on, a null one last.

    Sources are sorted across partitions; what reaches the driver is the number of sources in each partition.
    """
    order = F.col("source").asc_nulls_last()
    parted = Settled(per.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges").df
    before, sizes = 0, {r["part"]: r["n"] for r in parted.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts = []
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(before)]
        before += sizes[part]
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parted.withColumn("rank", place + (F.create_map(*starts)[F.col("part")] if starts else F.lit(0))).drop("part")


def targets(sizes: DataFrame) -> DataFrame:
    """source, n_docs, source_size and target for each source of a frame with `source` and `size`.

    Weights repeat along the sources in code point order, a null source last. Shares that exceed MOST times a source's size stop
    there and the excess goes to the others by weight. The level that uncapped sources reach per unit of weight is found by
    aggregation: from the level without caps on, those that it would take beyond their caps are set aside and the level rises, until it
    takes none. Sums are of whole numbers, so reruns agree to the last bit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("rank", F.lit(len(WEIGHTS))).cast("int") + 1)
    per = Settled(numbered(per).withColumn("weight", weight), "mix-weights").df
    total = per.agg(F.sum("source_size")).first()[0] or 0
    most, level = F.col("source_size") * F.lit(MOST), 0.0
    while True:
        over = most < F.col("weight") * F.lit(level)
        capped, open_ = per.agg(F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not open_:
            break
        before, level = level, (TOTAL * total - MOST * (capped or 0)) / open_
        if level <= before:
            break
    return per.select("source", "n_docs", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def fly(p: list[float], size: list[float], rng: np.random.Generator) -> list[int]:
    """Move probabilities, keeping their sum and the sum of p * size, until at most two are between 0 and 1; give those."""
    chance = rng.random(len(p) + 8).tolist()
    active: list[int] = []
    upto = used = 0
    eps = 1e-9
    while True:
        while len(active) < 3 and upto < len(p):
            if eps < p[upto] < 1 - eps:
                active.append(upto)
            else:
                p[upto] = float(round(p[upto]))
            upto += 1
        if len(active) < 3:
            return active
        a, b, c = active
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        active = _step(p, active, u, chance[used % len(chance)], eps)
        used += 1


def _step(p: list[float], units: list[int], u: tuple, chance: float, eps: float) -> list[int]:
    """Go along u or against it, as far as 0 and 1 allow, by chances that keep each unit's expectation; give the open units."""
    up = down = math.inf
    for k, d in zip(units, u, strict=True):
        if d > 0:
            up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
        elif d < 0:
            up, down = min(up, -p[k] / d), min(down, -(1 - p[k]) / d)
    t = up if chance * (up + down) < down else -down
    still = []
    for k, d in zip(units, u, strict=True):
        p[k] += t * d
        if eps < p[k] < 1 - eps:
            still.append(k)
        else:
            p[k] = float(round(p[k]))
    return still


def land(p: list[float], size: list[float], units: list[int], free: list[int], want: float, rng: np.random.Generator) -> None:
    """Settle the last units: two keep the words' sum as far as they can, the last one falls by its own chance.

    What words are then too many or too few, against `want`, one exchange makes good: of the units that were `free` at the
    start, a taken and an untaken one change places whose sizes differ by nearly as much. That keeps the number of documents.
    """
    if len(units) == 2:
        u = (float(size[units[1]]), -float(size[units[0]]))
        units = _step(p, units, u if any(u) else (1.0, -1.0), rng.random(), 1e-9)
    for k in units:
        p[k] = 1.0 if rng.random() < p[k] else 0.0
    over = sum(x * s for x, s in zip(p, size, strict=True)) - want
    taken, others = [k for k in free if p[k] == 1.0], np.array([k for k in free if p[k] == 0.0], dtype=int)
    if not taken or not len(others) or abs(over) < 0.5:
        return
    of = np.array([size[k] for k in others])
    by_size = np.argsort(of, kind="stable")
    of, others = of[by_size], others[by_size]
    need = np.array([size[k] for k in taken]) - over
    at = np.clip(np.searchsorted(of, need), 1, max(len(of) - 1, 1))
    best = min(((abs(need[i] - of[j]), i, j) for i in range(len(taken)) for j in (at[i] - 1, min(at[i], len(of) - 1))), key=lambda x: x[0])
    if best[0] < abs(over):
        p[taken[best[1]]], p[int(others[best[2]])] = 0.0, 1.0


def _fly_block(block: pa.Table) -> pa.Table:
    """One block of one source; of a source in one block, the last units land."""
    order = sorted(range(block.num_rows), key=lambda i, s=block["size"].to_pylist(), k=block["key"].to_pylist(), n=block["copy"].to_pylist(): (-s[i], k[i], n[i]))
    block = block.take(pa.array(order, type=pa.int64()))
    rng = np.random.default_rng(seed_of("mix", block["source"][0].as_py(), block["block"][0].as_py(), block["round"][0].as_py()))
    p, size = block["p"].to_pylist(), [float(x) for x in block["size"].to_pylist()]
    free, want = [k for k, x in enumerate(p) if 1e-9 < x < 1 - 1e-9], sum(x * s for x, s in zip(p, size, strict=True))
    units = fly(p, size, rng)
    if block["n_blocks"][0].as_py() == 1:
        land(p, size, units, free, want, rng)
    return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p, type=pa.float64()))


def _blocks(df: DataFrame, n: Column, step: int) -> DataFrame:
    """Add block, n_blocks and round, n being the rows of a source."""
    n_blocks = F.greatest(F.ceil(n / BLOCK_ROWS), F.lit(1)).cast("long")
    return df.withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64(F.lit(step), "key", "copy"), "n_blocks")).withColumn("round", F.lit(step))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", key: Column | None = None) -> DataFrame:
    """id, key, source, size, source_size, target, copies (0, 1 or 2) and taken for every document.

    `key` orders documents within blocks (by default the id as text, of rows without id a hash of the text); rows that share
    id, key, source and size count as copies of one document. A null text has size 0; a null source is a source of its own, the last one.
    Documents of size 0 may be taken but add no words. Repeated rows are counted and numbered first, so that they spread over blocks
    however many there are. Reruns give equal results, whatever the partitioning. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64(F.col(text_col).cast("string"))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.coalesce(key if key is not None else own, F.lit("")).alias("key"))
    alike = rows.groupBy("id", "source", "size", "key").agg(F.count("*").alias("_rows"))
    sized = Settled(alike.select("id", "source", "size", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))).alias("copy")), "mix-sizes").df
    with scratch() as kept:
        kept.append(Settled(targets(sized), "mix-targets"))
    per = kept[0].df
    about = per.agg(F.count("*").alias("n"), F.max("n_docs").alias("most"), F.sum(F.octet_length(F.coalesce("source", F.lit("")))).alias("bytes")).first()
    most, few = about["most"] or 0, about["n"] <= BROADCAST_SOURCES and (about["bytes"] or 0) <= BROADCAST_SOURCES * NAME_BYTES
    joined = sized.join(F.broadcast(per) if few else per, sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(times + 1e-12)
    start = joined.withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(times - whole, F.lit(0.0)))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, source string, size long, key string, copy long, n_docs long, source_size long, target double, whole long, p double, n_blocks long, block long, round int"
    todo, done, step = _blocks(start, F.col("n_docs"), 0), [], 0
    while True:
        flown = Settled(todo.groupBy("source", "block").applyInArrow(_fly_block, schema), f"mix-{step}").df
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.filter(~open_))
        if most <= BLOCK_ROWS:
            break
        step += 1
        # a block leaves two rows at most; with so many per source, the next round's blocks stay bounded too
        most = 2 * math.ceil(most / BLOCK_ROWS)
        todo = _blocks(flown.filter(open_).drop("block", "round"), 2 * F.col("n_blocks"), step)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select("id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
