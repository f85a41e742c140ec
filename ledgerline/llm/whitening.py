"""Whitening of embeddings by a covariance that is computed in tiles.

Dimensions are cut into column blocks, and each pair of blocks is a tile of the covariance. Rows are cut into row blocks; of each, its column blocks
go to the tiles that need them, where the two blocks of a pair are multiplied. Products are summed where they are made, then per tile over all
tasks. Only the finished tiles, as many numbers as dimensions squared, are assembled on the driver and decomposed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled, scratch

#: Dimensions of a column block, rows of a row block, components that are kept.
TILE, ROWS, COMPONENTS = 32, 4096, 32
SCALE, OFFSET = 64, 1_000_000
#: Scaled entries beyond this count as it, as 64 bits can't hold them.
FAR = 2.0**60
#: Eigenvalues below this share of the trace are rounding; such directions can't be scaled to variance 1.
LEAST = 1e-12


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the entries as whole numbers, of the rows whose vector is neither null nor empty and has only finite entries."""
    v = F.col(vector_col).cast("array<double>")
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.filter(fit).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(FAR)), F.lit(-FAR))).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def summed(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each dimension of x; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(0), dims, np.int64)
            # halves of 32 bits, so that no sum of a batch leaves 64 bits
            yield pa.RecordBatch.from_arrays([pa.array([len(m)]), pa.array([(m >> 32).sum(0)]), pa.array([(m & 0xFFFFFFFF).sum(0)])], names=["n", "high", "low"])

    parts = rows.select("x").mapInArrow(run, "n long, high array<long>, low array<long>")
    # a row for each dimension; partial sums are merged before they are shuffled
    each = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s"))
    total = each.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
    found = total.orderBy("dim").collect()
    return found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def covariance(rows: DataFrame, dims: int, n: int, total: list[int] | np.ndarray) -> np.ndarray:
    """The covariance, divisor n, of the entries of x (array) over all `rows`, centred with the totals before it is multiplied."""
    blocks = [(k, min(k + TILE, dims)) for k in range(0, dims, TILE)]
    exact = all(isinstance(t, int) for t in total)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.column(0).slice(low, ROWS)
                c = centred(_matrix(part, dims, np.int64), n, total) if exact else _matrix(part, dims, np.float64) - np.asarray(total) / n
                made = [c[:, a:b].tobytes() for a, b in blocks]
                # each column block to every tile that it is a side of
                pairs = [(i, j, k) for i in range(len(blocks)) for j in range(i, len(blocks)) for k in {i, j}]
                for at in range(0, len(pairs), 64):
                    some = pairs[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(some)), *(pa.array([p[x] for p in some], pa.int32()) for x in range(3)), pa.array([made[p[2]] for p in some], pa.binary())], names=["row_block", "one", "two", "side", "cells"])
                block += 1

    def multiply(group: pa.Table) -> pa.Table:
        one, two = group["one"][0].as_py(), group["two"][0].as_py()
        side = {s: np.frombuffer(c, np.float64) for s, c in zip(group["side"].to_pylist(), group["cells"].to_pylist(), strict=True)}
        left, right = (side[k].reshape(-1, blocks[k][1] - blocks[k][0]) for k in (one, two))
        return pa.table([pa.array([one], pa.int32()), pa.array([two], pa.int32()), pa.array([(left.T @ right).tobytes()], pa.binary())], names=["one", "two", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for one, two, cells in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held[one, two] = held.get((one, two), 0) + np.frombuffer(cells, np.float64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["one", "two", "cells"])

    tile = "one int, two int, cells binary"
    products = rows.select("x").mapInArrow(cut, "row_block long, one int, two int, side int, cells binary").groupBy("row_block", "one", "two").applyInArrow(multiply, tile)
    tiles = products.mapInArrow(add, tile).groupBy("one", "two").applyInArrow(_sum_tiles, tile)
    out = np.zeros((dims, dims))
    for r in tiles.collect():
        (a, b), (c, d) = blocks[r["one"]], blocks[r["two"]]
        out[a:b, c:d] = np.frombuffer(r["cells"], np.float64).reshape(b - a, d - c) / n
        out[c:d, a:b] = out[a:b, c:d].T
    return out


def _sum_tiles(group: pa.Table) -> pa.Table:
    cells = sum(np.frombuffer(c, np.float64) for c in group["cells"].to_pylist())
    return pa.table([group["one"].slice(0, 1), group["two"].slice(0, 1), pa.array([cells.tobytes()], pa.binary())], names=["one", "two", "cells"])


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x less the mean; the whole numbers n * x - S are exact where they fit into 64 bits, as they are divided only at the end."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, total)))
    d = n * x - np.array(total, dtype=np.int64) if 2 * most < 2**63 else n * x.astype(object) - np.array(total, dtype=object)
    return d.astype(np.float64) / n


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 for each row, exact; null where 64 bits can't hold it."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, total))
    if most < 2**62 and (d := n * x - np.array(total, dtype=np.int64)).size and int(np.abs(d).max()) ** 2 * d.shape[1] < 2**63:
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(total, dtype=object)
    return [s if s < 2**63 else None for s in (d * d).sum(1).tolist()] if d.size else []


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of a covariance, falling, and its eigenvectors as columns, COMPONENTS at most; directions without variance are left out."""
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    able = int((e[:COMPONENTS] > max(np.trace(v), 0) * LEAST).sum())
    return e[:able], w[:, :able]


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable row and component.

    Rows whose vector is null, empty or holds a null or a non-finite entry are dropped, and so are those whose length isn't the commonest (of equals, the
    largest). Repeated rows, rows that share an id and rows without id count as often as they come. Scaled entries beyond FAR count as it. Directions without variance give no component,
    so a single row, or rows that are all equal, give no rows; neither does an empty table. Other columns aren't read.
    """
    spark = vectors.sparkSession
    with scratch() as kept:
        held = Settled(whole(vectors, id_col, vector_col), "whole-vectors")
        common = held.df.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        if common is None:
            return spark.createDataFrame([], _SCHEMA)
        dims = common["dims"]
        rows = held.df.filter(F.size("x") == dims)
        n, total = summed(rows, dims)
        v = covariance(rows, dims, n, total)
        e, w = components(v)
        if not len(e):
            return spark.createDataFrame([], _SCHEMA)
        turn = w / np.sqrt(e)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column(1), dims, np.int64)
                z = centred(m, n, total) @ turn
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(m, n, total), pa.int64()), flat], names=["vec_id", "deviation", "x"])

        made = Settled(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, "vec_id long, deviation long, x array<double>"), "whitened")
        kept.append(made)
        # the identity's test is the same tiled covariance, over what was whitened
        sums = made.df.select(F.posexplode("x").alias("dim", "c")).groupBy("dim").agg(F.sum("c").alias("s")).orderBy("dim").collect()
        error = float(np.abs(covariance(made.df, len(e), n, np.array([r["s"] for r in sums])) - np.eye(len(e))).max())
    share = F.array(*[F.lit(float(s)) for s in e / np.trace(v)])
    out = made.df.select("vec_id", "deviation", F.posexplode("x").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
