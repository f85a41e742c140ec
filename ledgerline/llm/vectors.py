"""Near-duplicate vectors by lattice hashing.

Random orthonormal projections take a unit vector to eight dimensions, where it is decoded to the nearest point of the E8
lattice; each of several tables has a projection and a shift of its own. A vector is filed under its lattice point and also asks
for the neighbouring points nearest to it. Vectors that meet under a point are compared by cosine, in blocks: points with many
vectors are cut into blocks by hash, and each pair of blocks is a task's group of bounded size. Of a block pair, only the number of
each vector's links and a forest that spans them go on, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled
from .components import components

COSINE = 0.98
TABLES, PROBES, SCALE = 10, 2, 3.2
DIM = 8
SEED = 20240229
#: Vectors of a lattice point that one block takes, in expectation.
BLOCK = 256
_HALF = np.array([[0.0] * 8, [0.5] * 8])
#: The 240 shortest vectors of E8: two entries of 1 or -1, or eight of 1/2 or -1/2 with an even number of minus signs.
_SHORT = np.array(
    [[s if k == i else t if k == j else 0.0 for k in range(8)] for i in range(8) for j in range(i) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    + [[0.5 - (b >> k & 1) for k in range(8)] for b in range(256) if bin(b).count("1") % 2 == 0]
)


def decode_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer entries of even sum: round all, and where the sum is odd, the worst entry the other way."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 shifted by 1/2 in every entry."""
    one, two = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - two) ** 2).sum(1) < ((x - one) ** 2).sum(1)
    return np.where(nearer[:, None], two, one)


def projections(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A matrix and a shift for each table, by a fixed seed; the matrix keeps lengths in expectation."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(TABLES):
        q, _ = np.linalg.qr(rng.standard_normal((dim, min(dim, DIM))))
        p = np.zeros((dim, DIM))
        p[:, : q.shape[1]] = q
        out.append((p * np.sqrt(dim / q.shape[1]) * SCALE, rng.uniform(0, 1, DIM)))
    return out


def _code(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit hashes of lattice points; all entries are multiples of a half."""
    z = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    h = np.full(len(z), table + 1, dtype=np.uint64)
    for k in range(z.shape[1]):
        h = (h ^ z[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector and table, the hash of its lattice point, and those of its PROBES nearest neighbouring points."""
    home = np.zeros((len(unit), TABLES), dtype=np.int64)
    near = np.zeros((len(unit), TABLES, PROBES), dtype=np.int64)
    for t, (p, shift) in enumerate(projections(unit.shape[1])):
        x = unit @ p + shift
        point = decode_e8(x)
        home[:, t] = _code(point, t)
        # |x - point - s|^2 is least where (x - point) . s is largest, as all s are equally long
        best = np.argpartition(-((x - point) @ _SHORT.T), PROBES, axis=1)[:, :PROBES]
        for k in range(PROBES):
            near[:, t, k] = _code(point + _SHORT[best[:, k]], t)
    return home, near


def usable(vectors: list) -> tuple[list[np.ndarray], list[int]]:
    """The vectors that have a direction, scaled to length 1, and their positions."""
    at, rows = [], []
    for i, v in enumerate(vectors):
        if v is not None and len(v) and all(x is not None for x in v):
            a = np.array(v, dtype=np.float64)
            if np.isfinite(a).all() and (n := np.linalg.norm(a / max(np.abs(a).max(), 1e-300))) > 0 and np.abs(a).max() > 0:
                at.append(i)
                rows.append(a / np.abs(a).max() / n)
    return rows, at


def hashed(classes: DataFrame, label_type: str) -> DataFrame:
    """node, label, n, unit (bytes of the unit vector), home and near (lattice hashes) for classes whose vectors have a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                rows, at = usable(part.column(3).to_pylist())
                dims = np.array([len(r) for r in rows])
                home, near = np.zeros((len(rows), TABLES), dtype=np.int64), np.zeros((len(rows), TABLES, PROBES), dtype=np.int64)
                for d in set(dims.tolist()):
                    own = np.flatnonzero(dims == d)
                    home[own], near[own] = cells(np.array([rows[i] for i in own]))
                left = part.take(pa.array(at, type=pa.int64()))
                made = [pa.array([r.tobytes() for r in rows], type=pa.binary()), pa.array(list(home), type=pa.list_(pa.int64())), pa.array(list(near.reshape(len(rows), -1)), type=pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([left.column(0), left.column(1), left.column(2), *made], names=["node", "label", "n", "unit", "home", "near"])

    return classes.mapInArrow(run, f"node long, label {label_type}, n long, unit binary, home array<long>, near array<long>")


def _counted(home_a: np.ndarray, near_a: np.ndarray, home_b: np.ndarray, near_b: np.ndarray, at: int) -> np.ndarray:
    """Whether the pairs meet first under `at`, of all the points where they meet: tables in order, home points before probed ones."""
    same = home_a == home_b
    into_b = (near_a == home_b[:, :, None]).any(2)  # a asks for b's point
    into_a = (near_b == home_a[:, :, None]).any(2)
    meet = same | into_b | into_a
    first = meet.argmax(1)
    row = np.arange(len(first))
    ha, hb, a_asks, b_asks = home_a[row, first], home_b[row, first], into_b[row, first], into_a[row, first]
    point = np.where(same[row, first], ha, np.where(a_asks & b_asks, np.minimum(ha, hb), np.where(a_asks, hb, ha)))
    return meet.any(1) & (point == at)


def _link_block(group: pa.Table) -> pa.Table:
    """Links between the two blocks of a pair, or within one: counts for each node, and a spanning forest as links to its roots."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    point, one, two = group["point"][0].as_py(), group["one"][0].as_py(), group["two"][0].as_py()
    node, block, probe, n = (np.array(group[c].to_pylist()) for c in ("node", "block", "probe", "n"))
    order = np.lexsort((probe, node))
    node, block, probe, n = node[order], block[order], probe[order], n[order]
    first = np.append(True, node[1:] != node[:-1])
    keep = order[first]
    node, block, probe, n = node[first], block[first], probe[first], n[first]
    group = group.take(pa.array(keep))
    units = [np.frombuffer(u, dtype=np.float64) for u in group["unit"].to_pylist()]
    home = np.array(group["home"].to_pylist(), dtype=np.int64)
    near = np.array(group["near"].to_pylist(), dtype=np.int64).reshape(len(home), TABLES, PROBES)
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    found: list[tuple[int, int]] = []
    dims = np.array([len(u) for u in units])
    for d in set(dims.tolist()):
        i_all, j_all = left[dims[left] == d], right[dims[right] == d]
        if not len(i_all) or not len(j_all):
            continue
        dot = np.array([units[i] for i in i_all]) @ np.array([units[j] for j in j_all]).T
        i, j = np.nonzero(dot >= COSINE)
        i, j = i_all[i], j_all[j]
        able = ~(probe[i] & probe[j]) & ((node[i] < node[j]) if one == two else (node[i] != node[j]))
        i, j = i[able], j[able]
        for low in range(0, len(i), 20_000):
            a, b = i[low : low + 20_000], j[low : low + 20_000]
            ok = _counted(home[a], near[a], home[b], near[b], point)
            found += zip(a[ok].tolist(), b[ok].tolist(), strict=True)
    if not found:
        return schema.empty_table()
    links = np.zeros(len(node), dtype=np.int64)
    root = list(range(len(node)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in found:
        links[a] += n[b]
        links[b] += n[a]
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)  # nodes are in order
    at = np.flatnonzero(links)
    return pa.table([pa.array(node[at]), pa.array(links[at]), pa.array(node[[top(x) for x in at.tolist()]])], schema=schema)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors of the label linked directly), component_id (smallest id that links reach) and kept, one row per id.

    Two vectors of equal, non-null label are linked if they meet in a table and their cosine, in double precision, is at least
    COSINE. Equal vectors of a label are one class from the start; their links with each other count. Vectors that are null, empty
    or zero, or hold a null or a component that isn't finite, and those without label link with nothing. Rows that repeat an
    id count once, by the smallest (label, vector). Vectors of different lengths don't link. A row without id has no id to be
    reached by: it links with nothing and is kept. Other columns aren't read. An empty table gives no rows.
    """
    label_type = vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = Settled(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v"), "vectors").df
    # 128 bits of the components stand for the vector; -0.0 counts as 0.0
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    keyed = rows.filter("vec_id is not null and label is not null and v is not null").select("vec_id", "label", "v", F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit("vector"), plain).alias("k2"))
    classes = Settled(keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")), "vector-classes").df
    lattice = Settled(hashed(classes.select("node", "label", "n", "v"), label_type), "lattice").df
    filed = lattice.select("node", "label", F.explode("home").alias("point"), F.lit(False).alias("probe")).unionAll(lattice.select("node", "label", F.explode("near").alias("point"), F.lit(True).alias("probe")))
    # only points where at least two vectors meet, one of them at home
    met = filed.groupBy("label", "point").agg(F.count("*").alias("m"), F.count_if(~F.col("probe")).alias("homes")).filter("m > 1 and homes > 0")
    met = met.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    kept = Settled(filed.join(met.select("label", "point", "blocks"), ["label", "point"]), "lattice-met")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = kept.df.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("node", "label", "point", "probe", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    full = spread.join(lattice.select("node", "n", "unit", "home", "near"), "node")
    linked = Settled(full.groupBy("label", "point", "one", "two").applyInArrow(_link_block, "node long, links long, root long"), "vector-links").df
    kept.drop()
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("root").alias("a"), F.col("node").alias("b")))
    usable_nodes = lattice.select("node", "n")
    named = usable_nodes.join(counts, "node", "left").join(roots, "node", "left").select("node", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    per_id = keyed.join(classes.select("label", "k1", "k2", "node"), ["label", "k1", "k2"]).select("vec_id", "node").join(named, "node")
    per_id = per_id.select(F.col("vec_id").alias("id"), (F.col("links") + F.col("n") - 1).alias("n_links"), F.col("root").alias("component_id"))
    out = rows.select("vec_id").join(per_id, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
