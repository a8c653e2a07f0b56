"""Curve rows to array archives (.npz with four row-aligned arrays): what ``sources.archives`` reads."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracesieve.session import ship

#: Rows of an archive at most; a task holds one archive at a time.
ARCHIVE_ROWS = 4096


def _even(lists: pa.ListArray, name: str) -> int:
    """The one length of all lists; an archive's arrays have no ragged rows."""
    lengths = np.unique(np.diff(lists.offsets.to_numpy()))
    if lists.null_count or len(lengths) != 1:
        raise ValueError(f"{name} has rows of different lengths or null rows beside others: {lengths.tolist()[:5]}")
    return int(lengths[0])


def _arrays(rows: pa.Table) -> dict[str, np.ndarray]:
    """The four arrays of an archive; a column that is null throughout becomes a stub of one zero a row."""
    n = len(rows)
    trace, flat, image = [rows[c].combine_chunks() for c in ("x_raw", "x_1d", "image")]
    out = {"y_raw": rows["y_file"].to_numpy().reshape(n, 1), "x_raw": np.zeros((n, 1)), "x_1D_processed": np.zeros((n, 1))}
    if trace.null_count < n:
        steps, samples = _even(trace, "x_raw"), trace.flatten()
        out["x_raw"] = np.stack([f.to_numpy(zero_copy_only=False) for f in samples.flatten()], axis=-1).reshape(n, steps, -1)
    if flat.null_count < n:
        out["x_1D_processed"] = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, _even(flat, "x_1d"), 1)
    height, width, data = image.flatten()
    shapes = set(zip(height.to_pylist(), width.to_pylist()))
    if image.null_count or len(shapes) != 1:
        raise ValueError(f"images of one archive have one size, not {sorted(map(str, shapes))[:5]}")
    out["x_2D_processed"] = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(n, *shapes.pop())
    return out


def _put(folder: str, name: str, raw: bytes) -> None:
    """Write under a name of the attempt's own and rename: a repeated task does no harm."""
    from pyarrow import fs

    local = folder.startswith("file:") or ":/" not in folder
    files, where = fs.FileSystem.from_uri(f"file:///{os.path.abspath(folder.removeprefix('file:')).lstrip('/')}" if local else folder)
    files.create_dir(where, recursive=True)
    own = f"{where}/_{name}.{os.getpid()}-{os.urandom(6).hex()}"
    with files.open_output_stream(own) as out:
        out.write(raw)
    files.move(own, f"{where}/{name}")


def export_archives(rows: DataFrame, folder: str, name: str = "Experiment", archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Write ``curve_id, y_file, x_raw, x_1d, image`` as archives ``<name>-*.npz`` in key order; returns ``name, n``.

    There are as many ranges of keys as the rows need, and each archive holds at most ``archive_rows``, so a key of very many
    rows makes more archives and not a larger one.  ``folder`` is on a file system that all executors reach.
    An empty table makes no archives.
    """
    ship(rows.sparkSession)
    ranges = max(1, -(-rows.count() // archive_rows))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush() -> None:
            file, raw = f"{name}-{part:08d}-{len(made):06d}.npz", io.BytesIO()
            np.savez(raw, **_arrays(pa.Table.from_batches(held)))
            _put(folder, file, raw.getvalue())
            made.append((file, size))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, archive_rows - size)
                held.append(piece)
                at, size = at + piece.num_rows, size + piece.num_rows
                if size == archive_rows:
                    flush()
                    held, size = [], 0
        if size:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["name", "n"])

    columns = rows.select("curve_id", "y_file", "x_raw", "x_1d", "image")
    ranged = columns.repartitionByRange(ranges, "curve_id").sortWithinPartitions("curve_id")
    found = ranged.mapInArrow(write, "name string, n long").toArrow()  # a line for each archive
    return rows.sparkSession.createDataFrame(found)
