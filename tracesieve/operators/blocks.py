"""Meet every row with every anchor, by how many anchors there are.

Few: one map with the anchors broadcast.  More: one such map per part of the anchors, merged.
Very many: every block of one side with every block of the other.  All run the same numpy function on (rows) x (anchors).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tracesieve.session import spread, written

KEY, VEC = "curve_id", "x"
CELLS = 4 << 20  # point x anchor cells computed at once in a task
BLOCK_BYTES, FILE_BLOCKS = 8 << 20, 16  # vectors in a block of the tiled way, and blocks in one of its files
SENT = 1 << 20  # cells computed, or numbers sent, at once where rows are copied to the groups that they ask


@dataclass(frozen=True)
class Limits:
    """Largest anchor table that may be broadcast, the most passes over the points with a part
    of the anchors each, and the tile edge used beyond that.

    ``spread`` is off where the points are known to be spread over the cores already.
    Broadcasts made under these limits are added to ``bag``, if given, for the caller to
    destroy once the results are used: a loop would otherwise keep one per round.
    """

    rows: int = 16384
    bytes: int = 256 << 20
    passes: int = 32
    block: int = 2048
    spread: bool = True
    bag: list | None = None

    def share(self, spark, value):
        shared = spark.sparkContext.broadcast(value)
        if self.bag is not None:
            self.bag.append(shared)
        return shared


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten()
    if flat.null_count or len(flat) % n or len(set(column.value_lengths().to_numpy().tolist())) > 1:
        raise ValueError("vectors must be equally long and hold no nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)


def vectors(rows: np.ndarray) -> pa.Array:
    """A 2-D array as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows).ravel())
    )


def copies(batch: pa.RecordBatch, row: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Row ``row[i]`` with ``g = group[i]`` for every ``i``, in batches of about ``SENT`` numbers: a row may be asked for by every group."""
    flat = sum(batch.num_rows * 8 if not pa.types.is_list(c.type) else len(c.flatten()) * 8 for c in batch.columns)
    step = max(1, 8 * SENT * batch.num_rows // max(1, flat))
    for at in range(0, len(row), step):
        part = batch.take(pa.array(row[at : at + step]))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(group[at : at + step].astype(np.int64, copy=False))], names=[*batch.schema.names, "g"])


def power_distance(a: np.ndarray, b: np.ndarray, l: float) -> np.ndarray:
    """Sum over |a - b|^l for every pair: the l-norm raised to l."""
    if not (l > 0 and math.isfinite(l)):
        raise ValueError("l must be a finite positive number")
    if l == 2:
        d = a @ b.T
        d *= -2.0
        d += np.einsum("ij,ij->i", a, a)[:, None]
        d += np.einsum("ij,ij->i", b, b)[None, :]
        return np.maximum(d, 0.0, out=d)
    out = np.empty((len(a), len(b)))
    step = max(1, (4 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        diff = np.abs(a[i : i + step, None, :] - b[None, :, :])
        out[i : i + step] = (diff if l == 1 else diff**l).sum(axis=2)
    return out


def fetch(anchors: DataFrame | pa.Table, limits: Limits) -> pa.Table | None:
    """The anchor table in key order, or None when it is over the limits.

    One row is read first for the width, so that no more rows are asked for than the byte limit
    allows, however well the table is compressed.
    """
    if isinstance(anchors, pa.Table):
        table, most = anchors, limits.rows
    else:
        most = most_rows(anchors, limits)
        table = anchors.limit(most + 1).toArrow()
    if table.num_rows > most or table.nbytes > limits.bytes:
        return None
    return table.sort_by(KEY)


def most_rows(anchors: DataFrame, limits: Limits) -> int:
    """How many anchors of this width may be broadcast."""
    first = anchors.select(F.size(VEC)).first()
    return min(limits.rows, limits.bytes // (8 * max(1, first[0] if first else 1)))


Tile = Callable[[pa.Table, pa.Table], pa.Table]


def _as_vectors(df: DataFrame) -> DataFrame:
    if df.schema[VEC].dataType == T.ArrayType(T.DoubleType()):
        return df
    return df.select(*[F.col(c).cast("array<double>").alias(c) if c == VEC else F.col(c) for c in df.columns])


def against_anchors(
    points: DataFrame,
    anchors: DataFrame | pa.Table,
    tile: Tile,
    schema: T.StructType,
    limits: Limits = Limits(),
    merge: Callable[[DataFrame], DataFrame] | None = None,
    partial: tuple[Tile, T.StructType] | None = None,
) -> DataFrame:
    """Apply ``tile(points, anchors)`` so that every row meets every anchor exactly once.

    Few anchors: one map over the points with the anchors broadcast, no shuffle.  More: they are
    cut by hash into parts below the limit and each part is broadcast to a map of its own, so the
    vectors of the points are never shuffled or copied.  Too many parts: both sides are cut into
    hash blocks (keys are unique, so blocks are even), shuffled and written once, and Spark's cross
    join of the written blocks reads them again for each other: disk grows with the vectors, not with
    the pairs.  ``merge`` combines the partial rows of a point over anchor parts
    (``partial`` names the tile function and schema of those rows where they differ).
    """
    points = _as_vectors(points)
    if isinstance(anchors, DataFrame):
        anchors = _as_vectors(anchors)
    table = fetch(anchors, limits)
    if table is not None:
        return _map_over(points, table, tile, schema, limits)
    tile, schema = partial or (tile, schema)
    if isinstance(anchors, pa.Table):
        anchors = points.sparkSession.createDataFrame(anchors)
    met = _in_passes(points, anchors, tile, schema, limits)
    if met is None:
        met = _in_tiles(points, anchors, tile, schema, limits)
    return merge(met) if merge else met


def _map_over(points: DataFrame, table: pa.Table, tile: Tile, schema: T.StructType, limits: Limits) -> DataFrame:
    shared = limits.share(points.sparkSession, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        step = max(1, CELLS // max(1, known.num_rows))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                rows = pa.Table.from_batches([batch.slice(start, step)])
                yield from tile(rows, known).to_batches()

    return (spread(points) if limits.spread else points).mapInArrow(run, schema)


def _in_passes(points: DataFrame, anchors: DataFrame, tile: Tile, schema: T.StructType, limits: Limits) -> DataFrame | None:
    """A broadcast map per hash part of the anchors; None if that takes too many passes."""
    parts = math.ceil(anchors.count() / max(1.0, 0.8 * most_rows(anchors, limits)))
    if parts > limits.passes:
        return None
    stored, out = written(anchors, "anchors"), None
    for i in range(parts):
        table = fetch(stored.where(F.pmod(F.xxhash64(KEY), F.lit(parts)) == i), limits)
        if table is None:
            return None
        if table.num_rows:
            one = _map_over(points, table, tile, schema, limits)
            out = one if out is None else out.unionByName(one)
    return out


def _packed(df: DataFrame, name: str, limits: Limits) -> DataFrame:
    """Hash blocks of bounded size, each one row of the shared folder: ``name`` is the list of its rows."""
    n, size = df.count(), most_rows(df, Limits(rows=limits.block, bytes=BLOCK_BYTES))
    blocks = max(1, math.ceil(n / max(1, size)))
    files = max(min(blocks, df.sparkSession.sparkContext.defaultParallelism), math.ceil(blocks / FILE_BLOCKS))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(KEY), F.lit(blocks))).repartition(files, "_b")
    return written(dealt.groupBy("_b").agg(F.collect_list(F.struct(*df.columns)).alias(name)).select(name), f"blocks-{name}")


def _in_tiles(points: DataFrame, anchors: DataFrame, tile: Tile, schema: T.StructType, limits: Limits) -> DataFrame:
    pairs = _packed(points, "p", limits).hint("shuffle_replicate_nl").crossJoin(_packed(anchors, "q", limits))

    def rows(block: pa.ListScalar) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(block.values)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(batch.column("p"), batch.column("q")):
                yield from tile(rows(p), rows(q).sort_by(KEY)).to_batches()

    return pairs.mapInArrow(meet, schema)
