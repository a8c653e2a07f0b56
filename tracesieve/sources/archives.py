"""Array archives (.npz with four row-aligned arrays) to curve rows.

An archive may hold any share of all rows, so work is split by row range, not by
file: one task per range opens the archive on the shared file system, seeks, and
reads its rows only.  Compressed members cannot be entered in the middle: an archive
that has some is inflated once, by one task that reads its four arrays side by side, a
range at a time, and its rows are written to the shared folder, where they are spread again.
"""

from __future__ import annotations

import zipfile
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tracesieve.functions.labels import recode_labels
from tracesieve.session import written
from tracesieve.sources.curves import CURVES, SAMPLE

MEMBERS = ("x_raw", "y_raw", "x_1D_processed", "x_2D_processed")  # fixed values: array names in an archive
MOST_TASKS = 4096  # that inflate archives side by side
ROWS = T.StructType(
    [T.StructField("y_file", T.IntegerType())] + [f for f in CURVES.fields if f.name not in ("y_raw", "x")]
)


def _open(path: str):
    """A seekable stream on the shared file system the path names."""
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _header(stream):
    """Shape and type of one array; refuses pickled objects and column-major order."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if dtype.hasobject or fortran:
        raise ValueError("archives must hold plain row-major numeric arrays")
    return shape, dtype


def _width(shape, dtype) -> int:
    """Bytes of one row."""
    return int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize


def _taken(stream, shape, dtype, count: int) -> np.ndarray:
    """The next ``count`` rows of a stream."""
    raw = stream.read(count * _width(shape, dtype))
    return np.frombuffer(raw, dtype=dtype).reshape((count,) + tuple(shape[1:]))


def _read_rows(archive: zipfile.ZipFile, member: str, start: int, count: int) -> np.ndarray:
    with archive.open(member + ".npy") as stream:
        shape, dtype = _header(stream)
        stream.seek(start * _width(shape, dtype), 1)
        return _taken(stream, shape, dtype, count)


def _plan(batches):
    """Row count, bytes per row and whether members are compressed, for each archive, from its array headers alone."""
    for frame in batches:
        found = []
        for path in frame["path"]:
            rows, width, packed = set(), 0, False
            with _open(path) as raw, zipfile.ZipFile(raw) as archive:
                for member in MEMBERS:
                    with archive.open(member + ".npy") as stream:
                        shape, dtype = _header(stream)
                    rows.add(shape[0])
                    width += _width(shape, dtype)
                    packed |= archive.getinfo(member + ".npy").compress_type != zipfile.ZIP_STORED
            if len(rows) != 1:
                raise ValueError(f"arrays of {path} differ in length: {sorted(rows)}")
            found.append((path, rows.pop(), width, packed))
        yield pd.DataFrame(found, columns=["path", "n_rows", "width", "packed"])


def _lists(values: pa.Array, n: int, each: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), values)


def _batch(path: str, first: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of one range; ``first`` is the key of its first row."""
    trace, label, flat, image = arrays
    count = len(label)
    if trace.ndim == 3 and trace.shape[2] != len(SAMPLE.fields):
        raise ValueError(f"x_raw of {path} has {trace.shape[2]} channels, not {len(SAMPLE.fields)}")
    if trace.ndim == 3:
        fields = [pa.array(np.ascontiguousarray(trace[:, :, i], dtype=np.float64).ravel()) for i in range(4)]
        trace_col = _lists(pa.StructArray.from_arrays(fields, SAMPLE.names), count, trace.shape[1])
    else:
        trace_col = pa.nulls(count, pa.list_(pa.struct([(f.name, pa.float64()) for f in SAMPLE.fields])))
    if flat.ndim == 3:
        flat_col = _lists(pa.array(flat.astype(np.float64).ravel()), count, flat.shape[1] * flat.shape[2])
    else:
        flat_col = pa.nulls(count, pa.list_(pa.float64()))
    height, width = image.shape[1], image.shape[2]
    data = pa.array([r.tobytes() for r in image.reshape(count, -1).astype(np.uint8)], pa.binary())
    sides = [pa.array(np.full(count, side, np.int32)) for side in (height, width)]
    image_col = pa.StructArray.from_arrays([*sides, data], ["height", "width", "data"])
    ids = pa.array(first + np.arange(count, dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array(label.reshape(count).astype(np.int32)), ids, trace_col, flat_col, image_col], names=ROWS.names[:5])


def _rows(batches):
    """The rows of ranges ``(path, start, n, first_id)`` of stored members, each found by its place."""
    for batch in batches:
        for path, start, count, first in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "n", "first_id")]):
            with _open(path) as raw, zipfile.ZipFile(raw) as archive:
                arrays = [_read_rows(archive, m, start, count) for m in MEMBERS]
            yield _batch(path, first + start, arrays)


def _inflated(batches):
    """The rows of whole archives ``(path, n_rows, step, first_id)``, all four members inflated once and side by side."""
    for batch in batches:
        for path, rows, step, first in zip(*[batch.column(c).to_pylist() for c in ("path", "n_rows", "step", "first_id")]):
            with ExitStack() as held:
                raws = [held.enter_context(_open(path)) for _ in MEMBERS]  # a place in the file for each member
                archives = [held.enter_context(zipfile.ZipFile(raw)) for raw in raws]
                streams = [held.enter_context(a.open(m + ".npy")) for a, m in zip(archives, MEMBERS)]
                kinds = [_header(stream) for stream in streams]
                for start in range(0, rows, step):
                    count = min(step, rows - start)
                    yield _batch(path, first + start, [_taken(stream, *kind, count) for stream, kind in zip(streams, kinds)])


def ingest_archives(spark: SparkSession, glob: str, dataset: str, chunk_bytes: int = 16 << 20) -> DataFrame:
    """Rows of every archive matching ``glob``; ``curve_id`` is the position over archives in path order.

    The arrays' headers are read here.  Archives with compressed members are inflated here too, a task for each, and their rows
    written to the shared folder: what is returned reads them from there, however often, and in as many tasks as they fill.
    """
    paths = spark.read.format("binaryFile").load(glob).select("path")  # content is pruned: listing only
    plan = paths.mapInPandas(_plan, "path string, n_rows long, width long, packed boolean")
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, listed by the driver anyway
    step = F.greatest(F.lit(1), F.floor(F.lit(chunk_bytes) / F.greatest("width", F.lit(1)))).cast("long")
    plan = written(plan.withColumn("first_id", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).where("n_rows > 0").withColumn("step", step), "archive-plan")
    ranges = (
        plan.where("not packed").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.col("step"))))
        .select("path", "start", F.least("step", F.col("n_rows") - F.col("start")).alias("n"), "first_id")
        .repartition("path", "start")
    )
    rows, packed = ranges.mapInArrow(_rows, ROWS), plan.where("packed").select("path", "n_rows", "step", "first_id")
    many = packed.count()
    if many:
        rows = rows.unionByName(written(packed.repartition(min(many, MOST_TASKS), "path").mapInArrow(_inflated, ROWS), "inflated"))
    return recode_labels(rows, dataset).drop("y_file").select("curve_id", "y_raw", "x_raw", "x_1d", "image")
