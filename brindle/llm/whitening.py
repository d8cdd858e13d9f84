"""Embedding whitening from a covariance that is computed tile by tile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.shared import partitions, prepared

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Dimensions of a tile at most and at least; between them there are two blocks of dimensions.
TILE_MOST, TILE_LEAST = 512, 16
#: Entries of this size and more, whose products a double cannot hold, count as not finite.
LARGEST = float(1 << 46)
#: Eigenvalues below this share of the largest are zero to double precision.
ZERO = 1e-11

_SUMS = "dimension int, n long, total decimal(38,0)"
_BLOCKS = "i int, j int, slot int, row_block long, side int, rows int, kind string, data binary"
_TILES = "i int, j int, slot int, n long, data binary"
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _remaining(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose vector has all entries, and their number of dimensions; a vector shorter than the longest one lacks entries."""
    whole = vectors.select("vec_id", "embedding").where(f"embedding is not null and not exists(embedding, c -> c is null or isnan(c) or abs(c) >= {LARGEST}D)")
    size = whole.agg(F.max(F.size("embedding"))).first()[0] or 0
    return whole.where(F.size("embedding") == size), size


def _values(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """floor(SCALE * c) of a batch, a row a vector: x without its offset."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, size)


def _sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension, without the offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, dtype=object)
        for batch in batches:
            values = _values(batch, size)
            n += len(values)
            total += values.sum(axis=0).astype(object)  # a batch has a thousand rows or so
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["dimension", "n", "total"])

    found = {r.dimension: r for r in rows.mapInArrow(run, _SUMS).groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    return found[0].n, [int(found[d].total) for d in range(size)]


@dataclass
class Fit:
    """n, S (without n times the offset) and, once fitted, the projection onto the components and their shares of the variance."""

    size: int
    n: int
    sums: list[int]
    projection: np.ndarray | None = None
    explained: np.ndarray | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    def whitened(self, values: np.ndarray) -> np.ndarray:
        return (values - self.mean) @ self.projection

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) squared: in longs if they cannot overflow, else in whole numbers; null where a long cannot hold it."""
        largest = max(int(np.abs(values).max(initial=0)) * self.n, *map(abs, self.sums), 1) * 2
        if largest * largest * self.size < 1 << 63:
            return np.square(values * self.n - np.array(self.sums)).sum(axis=1).tolist()
        exact = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in values.tolist()]
        return [x if x < 1 << 63 else None for x in exact]


def _cuts(size: int) -> list[tuple[int, int]]:
    """Blocks of dimensions."""
    width = min(TILE_MOST, max(TILE_LEAST, -(-size // 2)))
    return [(a, min(a + width, size)) for a in range(0, size, width)]


def _column_blocks(rows: DataFrame, size: int, slots: int) -> DataFrame:
    """Row blocks (an Arrow batch each) cut into column blocks: a row a tile, row block and side of the tile; on the diagonal the sides are one."""
    cuts = _cuts(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            values = _values(batch, size)
            if not len(values):
                continue
            kind = next(k for k in ("<i2", "<i4", "<i8") if values.min() >= np.iinfo(k).min and values.max() <= np.iinfo(k).max)
            columns = [np.ascontiguousarray(values[:, a:b].astype(kind)).tobytes() for a, b in cuts]
            out = [(i, j, side, columns[x]) for i in range(len(cuts)) for j in range(i, len(cuts)) for side, x in ((0, i), (1, j))[: 1 if i == j else 2]]
            n = len(out)
            constant = [pa.repeat(pa.scalar(v, k), n) for v, k in ((block % slots, pa.int32()), (block, pa.int64()))]
            numbers = [pa.array([o[c] for o in out], pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays(
                [numbers[0], numbers[1], *constant, numbers[2], pa.repeat(pa.scalar(len(values), pa.int32()), n), pa.repeat(kind, n), pa.array([o[3] for o in out], pa.binary())],
                ["i", "j", "slot", "row_block", "side", "rows", "kind", "data"],
            )
            block += 1

    return rows.mapInArrow(run, _BLOCKS)


def _tile(i: int, j: int, slot: int, n: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (i, j, slot)), pa.array([n], pa.int64()), pa.array([data.tobytes()], pa.binary())], ["i", "j", "slot", "n", "data"])


def _multiplied(blocks: DataFrame, mean: np.ndarray) -> DataFrame:
    """Sums of products of centred values: a tile for every (i, j, slot), whose blocks are sorted by row block and side. Holds one tile and one pair of blocks."""
    cuts = _cuts(len(mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n, left = None, None, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if key != (now := (r["i"], r["j"], r["slot"])):
                    if key is not None:
                        yield _tile(*key, n, total)
                    (a, b), (c, d) = cuts[r["i"]], cuts[r["j"]]
                    key, total, n = now, np.zeros((b - a, d - c)), 0
                a, b = cuts[r["j"] if r["side"] else r["i"]]
                centred = np.frombuffer(r["data"], dtype=r["kind"]).reshape(r["rows"], b - a) - mean[a:b]
                if r["side"] == 0:
                    left = centred
                if r["side"] == 1 or r["i"] == r["j"]:
                    total += left.T @ centred
                    n += r["rows"]
        if key is not None:
            yield _tile(*key, n, total)

    return blocks.repartition("i", "j", "slot").sortWithinPartitions("i", "j", "slot", "row_block", "side").mapInArrow(run, _TILES)


def _added(tiles: DataFrame, by_slot: bool = False) -> DataFrame:
    """Tiles of one (i, j), or of one (i, j, slot), added up; a task holds one sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n = None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"])
                if key == (now := (r["i"], r["j"], r["slot"] if by_slot else 0)):
                    total, n = total + data, n + r["n"]
                    continue
                if key is not None:
                    yield _tile(*key, n, total)
                key, total, n = now, data, r["n"]
        if key is not None:
            yield _tile(*key, n, total)

    keys = ["i", "j", *(["slot"] if by_slot else [])]
    return tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _TILES)


def covariance(rows: DataFrame, fit: Fit) -> np.ndarray:
    """Assembled from the tiles on the driver: as large as the number of dimensions squared, whatever the number of rows."""
    cuts = _cuts(fit.size)
    tiles = len(cuts) * (len(cuts) + 1) // 2
    slots = max(1, partitions(rows.sparkSession) // tiles)
    found = np.zeros((fit.size, fit.size))
    for r in _added(_multiplied(_column_blocks(rows, fit.size, slots), fit.mean)).toLocalIterator():
        (a, b), (c, d) = cuts[r.i], cuts[r.j]
        tile = np.frombuffer(bytes(r.data)).reshape(b - a, d - c) / fit.n
        found[a:b, c:d] = tile
        found[c:d, a:b] = tile.T
    return found


def _identity_error(rows: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity. Tasks add up their rows; their sums are added in two steps."""
    k, slots = fit.projection.shape[1], partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = 0, np.zeros((k + 1, k))
        for batch in batches:
            white = fit.whitened(_values(batch, fit.size))
            n += len(white)
            total[:k] += white.T @ white
            total[k] += white.sum(axis=0)
        yield _tile(0, 0, TaskContext.get().partitionId() % slots, n, total)

    sums = _added(_added(rows.mapInArrow(run, _TILES), by_slot=True)).first()
    total = np.frombuffer(bytes(sums.data)).reshape(k + 1, k) / sums.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a remaining row of `vectors` and component.

    Rows whose vector is null, or lacks an entry (null, not finite, of 2^46 or more, or missing because the vector is shorter than the longest
    one), are neither fitted nor returned. Repeated rows and null or repeated ids count each; other columns are ignored. Components with no variance, to
    double precision, cannot be whitened and are not returned: a table of equal vectors or of none gives no rows. A
    deviation that a long cannot hold is null.
    """
    spark = prepared(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"vec_id {kind}, {_OUT}")
    rows, size = _remaining(vectors)
    if not size:
        return nothing
    fit = Fit(size, *_sums(rows, size))
    cov = covariance(rows, fit)
    values, axes = np.linalg.eigh(cov)
    order = [int(i) for i in np.argsort(-values, kind="stable")[:components] if values[i] > ZERO * values.max() and values[i] > 0]
    if not order:
        return nothing
    fit.projection = axes[:, order] / np.sqrt(values[order])
    fit.explained = values[order] / np.trace(cov)
    error, k = _identity_error(rows, fit), len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _values(batch, size)
            n = len(found)
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.repeat(pa.scalar(fit.n, pa.int64()), n * k),
                    pa.array(fit.deviations(found), pa.int64()).take(each),
                    pa.array(fit.whitened(found).ravel()),
                    pa.array(np.tile(fit.explained, n)),
                    pa.repeat(error, n * k),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, f"vec_id {kind}, {_OUT}")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their first 32 components."""
    return whitened(prepared(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
