"""Embedding whitening by a tiled covariance.

Each entry c becomes the integer floor(64 c) + 1000000, and each different vector of integers counts
once in the fit list. The list is written as row-blocks. For the covariance each row-block, centred, is cut
into column blocks of ``tile`` dimensions; a pair (i, j), i <= j, of column blocks is a tile key, and
the column blocks of a row-block meet under each of their tile keys, where they are multiplied.
Products are summed within a task, then by (tile, share of the tasks), then by tile. What reaches the
driver is the matrix, of the size of a vector squared; its eigenvectors go back to the tasks
that whiten the rows.

A row-block goes to every tile of its columns, so it is shuffled (dimensions / tile) times: tiles are a
quarter of the dimensions, from 32 to 1,024.

Cases: null vectors and vectors with null or non-finite entries are dropped; entries beyond 2^47 count as
2^47, so that integers stay exact in doubles; where vectors differ in length, those of the length that has
most different vectors stay (of ties, the greater), and others are dropped; components without variance (as a double can
tell) are left out, so that one vector, or many equal ones, give no rows; a deviation beyond a
long is null; vec_id may be null or repeated, and each row counts; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyraster.llm.common import cut, ensure, remove, shared_dir

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_BYTES = 4_000_000
SHARES = 64
LEAST = 1e-11  # of the largest eigenvalue, times dimensions: below, a component has no variance
_LONG = 2**63 - 1
_BLOCK = pa.schema({"block": pa.string(), "dims": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.string()), "data": pa.binary()})
_COLUMNS = pa.schema({"i": pa.int32(), "j": pa.int32(), "block": pa.string(), "col": pa.int32(), "data": pa.binary()})


def integers(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length that occurs: (rows, their integer vectors) of the valid vectors of a list column."""
    column = pa.ListArray.from_arrays(column.offsets, column.values, mask=column.is_null()) if column.null_count else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    length = np.diff(offsets)
    valid = (bad[offsets[1:]] == bad[offsets[:-1]]) & (length > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(length[valid]):
        rows = np.flatnonzero(valid & (length == d))
        some = values[offsets[rows][:, None] + np.arange(d)]
        out.append((rows, np.floor(np.clip(some, -(2.0**47), 2.0**47) * SCALE).astype(np.int64) + SHIFT))
    return out


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, x) of the different vectors of each batch."""
    for batch in batches:
        for _, x in integers(batch.column("embedding")):
            raw = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel()).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(raw), pa.int32()), pa.array(raw, pa.binary())], names=["dims", "x"])


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors together in row-blocks, with the sums of their dimensions (as text, of any size)."""
    waiting: dict[int, list[bytes]] = {}
    part, k = TaskContext.get().partitionId(), 0

    def block(d: int) -> pa.RecordBatch:
        nonlocal k
        x = np.frombuffer(b"".join(waiting[d]), np.int64).reshape(-1, d)
        high, low = (x >> 26).sum(0).tolist(), (x & (1 << 26) - 1).sum(0).tolist()
        k += 1
        return pa.RecordBatch.from_pylist([{"block": f"{part}-{k}", "dims": d, "n": len(x), "sums": [str((a << 26) + b) for a, b in zip(high, low, strict=True)], "data": x.tobytes()}], schema=_BLOCK)

    for batch in batches:
        for d, x in zip(batch.column("dims").to_pylist(), batch.column("x").to_pylist(), strict=True):
            waiting.setdefault(d, []).append(x)
            if len(waiting[d]) * 8 * d >= BLOCK_BYTES:
                yield block(d)
                del waiting[d]
    for d in waiting:
        yield block(d)


class Centre:
    """n x - S over n: exact integers where they fit, as doubles for the products."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.most = max(map(abs, sums))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, of int64, or of Python's integers."""
        if self.n * int(np.abs(x).max(initial=0)) + self.most < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = self.scaled(x)
        if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2.0**62:
            return [None if (s := sum(int(v) ** 2 for v in row)) > _LONG else s for row in y]
        return (y * y).sum(1).tolist()


def _covariance(fit: DataFrame, d: int, centre: Centre, tile: int) -> np.ndarray:
    """The covariance of the fit list, tile by tile."""
    edges = [*range(0, d, tile), d]
    count = len(edges) - 1

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Column blocks of every row-block, under each of their tile keys."""
        for batch in batches:
            for name, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                y = centre(np.frombuffer(data, np.int64).reshape(-1, d))
                for c in range(count):
                    cols = np.ascontiguousarray(y[:, edges[c] : edges[c + 1]]).tobytes()
                    keys = [(min(c, e), max(c, e)) for e in range(count)]
                    yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "block": name, "col": c, "data": cols} for i, j in keys], schema=_COLUMNS)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum over a task of a tile's products; rows come in order of tile, row-block and column block."""
        share = TaskContext.get().partitionId() % SHARES
        at: tuple | None = None
        left: tuple[str, np.ndarray] | None = None
        total = np.zeros(0)
        for batch in batches:
            for r in batch.to_pylist():
                key, width = (r["i"], r["j"]), edges[r["col"] + 1] - edges[r["col"]]
                block = np.frombuffer(r["data"]).reshape(-1, width)
                if key != at:
                    if at is not None:
                        yield _tile(*at, share, total)
                    at, total, left = key, np.zeros((edges[key[0] + 1] - edges[key[0]], edges[key[1] + 1] - edges[key[1]])), None
                if key[0] == key[1]:
                    total += block.T @ block
                elif left is not None and left[0] == r["block"]:
                    total += left[1].T @ block
                else:
                    left = (r["block"], block)
        if at is not None:
            yield _tile(*at, share, total)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of equal keys, which are neighbours."""
        at, total = None, np.zeros(0)
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["i"], r["j"], r["share"])
                if key != at:
                    if at is not None:
                        yield _tile(*at, total)
                    at, total = key, np.zeros(len(r["data"]) // 8)
                total = total + np.frombuffer(r["data"])
        if at is not None:
            yield _tile(*at, total)

    dealt = fit.select("block", "data").mapInArrow(columns, "i int, j int, block string, col int, data binary")
    tiles = dealt.repartition("i", "j", "block").sortWithinPartitions("i", "j", "block", "col").mapInArrow(products, _TILES)
    tiles = tiles.repartition("i", "j", "share").sortWithinPartitions("i", "j", "share").mapInArrow(sums, _TILES).withColumn("share", F.lit(0))
    tiles = tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(sums, _TILES)
    v = np.zeros((d, d))
    for r in tiles.toLocalIterator():  # d squared numbers, one tile at a time
        a, b = slice(edges[r.i], edges[r.i + 1]), slice(edges[r.j], edges[r.j + 1])
        v[a, b] = np.frombuffer(r.data).reshape(a.stop - a.start, b.stop - b.start)
        v[b, a] = v[a, b].T
    return v / centre.n


_TILES = "i int, j int, share int, data binary"


def _tile(i: int, j: int, share: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([share], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "j", "share", "data"])


def _error(fit: DataFrame, d: int, centre: Centre, turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from the list itself."""
    k = turn.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for data in batch.column("data").to_pylist():
                z = centre(np.frombuffer(data, np.int64).reshape(-1, d)) @ turn
                first, second = first + z.sum(0), second + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(k), np.arange(k * k) + k]), pa.int32()), pa.array(np.concatenate([first, second.ravel()]))], names=["at", "v"])

    found = fit.select("data").mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k + k * k)
    for r in found:
        flat[r["at"]] = r.v
    mean, second = flat[:k] / centre.n, flat[k:].reshape(k, k) / centre.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = vectors.sparkSession
    rows, folder = ensure(vectors, vec_id="long", embedding="array<double>"), shared_dir(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    different = rows.select("embedding").mapInArrow(_vectors, "dims int, x binary").distinct()
    fit = cut(different.mapInArrow(_row_blocks, "block string, dims int, n long, sums array<string>, data binary"), f"{folder}/fit")
    sizes = fit.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    d, fit = sizes.dims, fit.where(F.col("dims") == sizes.dims)
    sums = fit.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at")
    centre = Centre(sizes.n, [int(r.s) for r in sums.collect()])
    v = _covariance(fit, d, centre, tile or min(1024, max(32, -(-d // 4))))
    e, axes = np.linalg.eigh(v)
    e, axes, spread = e[::-1], axes[:, ::-1], float(np.trace(v))
    kept = int((e > max(float(e[0]), 0.0) * LEAST * d).sum()) if e[0] > 0 else 0
    kept = min(kept, components)
    if not kept:
        return spark.createDataFrame([], schema)
    turn = axes[:, :kept] / np.sqrt(e[:kept])
    error = _error(fit, d, centre, turn)
    explained = e[:kept] / spread
    remove(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column("embedding")):
                if x.shape[1] != d:
                    continue
                m = len(at)
                again = pa.array(np.repeat(np.arange(m), kept))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)).take(again), pa.array(np.tile(np.arange(1, kept + 1), m), pa.int32()), pa.array(np.full(m * kept, centre.n), pa.int64()),
                     pa.array(centre.deviation(x), pa.int64()).take(again), pa.array((centre(x) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
