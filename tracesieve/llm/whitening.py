"""Whitening of embeddings: leading components of their covariance by spectral divide and conquer, then one map with them broadcast.

Sums and the centred covariance are Spark aggregates of cells; what reaches the driver is a matrix of the vectors' width, whatever their
number.  It is split there: the polar factor of the covariance less a shift tells the directions above the shift from those below, which
gives a projector on either subspace, and each is split again until single components are left.  Polar factors come from dynamically
weighted Halley steps by QR, without an inverse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracesieve.session import ship

COMPONENTS = 8
#: Entries become ``floor(SCALE * c) + OFFSET``.
SCALE, OFFSET = 1024, 100_000
#: Largest whole number an entry may become: sums of a batch then stay exact in 64 bits.
LARGEST = 1 << 40
#: Widest vectors whose covariance is held at once (32 MB).
WIDEST = 2048
#: Components whose eigenvalue is less than this share of the largest have no scale to divide by.
RANK = 1e-12


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: its eigenvalues' signs on its eigenvectors."""
    n = len(a)
    size = np.linalg.norm(a, 1)
    x, low = a / size, 1e-15  # no singular value that counts is below it
    eye = np.eye(n)
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
        now = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        now = (now + now.T) / 2
        moved = np.linalg.norm(now - x)
        x, low = now, min(1.0, low * (h + b * square) / (1 + c * square))
        if 1 - low < 1e-15 and moved < 1e-8:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the space a projector of that rank maps to, and of the rest."""
    lead = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")[:rank]
    start = np.linalg.qr(projector[:, lead])[0]
    random = np.random.default_rng(0).normal(size=(len(projector), rank))  # the leading columns may depend on one another
    for guess in (start, np.linalg.qr(projector @ random)[0]):
        whole = np.linalg.qr(projector @ guess, mode="complete")[0]
        if np.linalg.norm(projector @ whole[:, :rank] - whole[:, :rank]) < 1e-8:
            break
    return whole[:, :rank], whole[:, rank:]


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Subspaces whose components all come after the first ``count`` are not split.
    """
    n = len(a)
    values, columns = np.zeros(0), np.zeros((n, 0))
    stack = [(a, np.eye(n))]  # subspaces, the largest eigenvalues on top
    tiny = 4 * np.finfo(float).eps * max(np.linalg.norm(a), np.finfo(float).tiny)
    while stack and columns.shape[1] < count:
        own, basis = stack.pop()
        m, centre = len(own), np.trace(own) / len(own)
        if m == 1 or np.linalg.norm(own - centre * np.eye(m)) <= tiny:
            values, columns = np.append(values, np.diag(own)), np.hstack([columns, basis])
            continue
        # The median of the diagonal cuts near the middle; the mean always lies between two eigenvalues.
        for shift in (float(np.median(np.diag(own))), centre, centre + tiny, centre - tiny):
            sign = polar(own - shift * np.eye(m))
            rank = int(round((m + np.trace(sign)) / 2))
            whole = np.linalg.norm(sign @ sign - np.eye(m)) < 1e-6  # not so if the shift is an eigenvalue
            if whole and 0 < rank < m:
                break
        else:
            raise ArithmeticError("no shift splits the matrix")
        up, down = _bases((np.eye(m) + sign) / 2, rank)
        for part in (down, up):
            inner = part.T @ own @ part
            stack.append(((inner + inner.T) / 2, basis @ part))
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], columns[:, order]


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are not null or empty and hold finite numbers only; and those as rows of whole numbers ``x``."""
    column = column.cast(pa.list_(pa.float64()))
    starts = column.offsets.to_numpy()
    lengths = np.diff(starts)
    lengths[np.asarray(column.is_null())] = 0
    values = column.values.to_numpy(zero_copy_only=False)  # a null entry is read as not a number
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = (lengths > 0) & (bad[starts[:-1] + lengths] == bad[starts[:-1]])
    widths = np.unique(lengths[good])
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} and of {widths[-1]} entries")
    if not len(widths):
        return good, np.zeros((0, 0), np.int64)
    rows = values[(starts[:-1][good])[:, None] + np.arange(widths[0])]
    whole = np.floor(SCALE * rows) + OFFSET
    if np.abs(whole).max() > LARGEST:
        raise ValueError("an entry is too large to be summed exactly")
    return good, whole.astype(np.int64)


def squares(far: np.ndarray) -> pa.Array:
    """The sum of the squares of each row, exactly."""
    most = float(np.abs(far).max())
    if most * most * far.shape[1] < 2.0**62:
        return pa.array((far * far).sum(axis=1).astype(np.int64)).cast(pa.decimal128(38, 0))
    if far.dtype == object or most >= 2.0**50:
        return pa.array([Decimal(int(s)) for s in (far.astype(object) ** 2).sum(axis=1)], pa.decimal128(38, 0))
    high, low = far >> 25, far & ((1 << 25) - 1)  # each product of two halves is below 2^50, and so many of them fit 64 bits
    parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return pa.array([Decimal((a << 50) + (b << 26) + c) for a, b, c in zip(*[p.tolist() for p in parts])], pa.decimal128(38, 0))


def _cells(read: DataFrame, made: Callable[[np.ndarray], Iterator[tuple[str, np.ndarray]]], schema: str) -> DataFrame:
    """Sums of equally shaped arrays that ``made`` gives of a batch's vectors: a row for each cell, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = _usable(batch.column(batch.num_columns - 1))
            if len(x):
                cells, counts = made(x), np.full(x.shape[1], len(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells), pa.array(np.resize(counts, len(cells)))], names=["cell", "v", "n"])

    found = read.mapInArrow(run, f"cell int, v {schema}, n long")
    total = F.col("v").cast("decimal(38,0)") if schema == "long" else F.col("v")
    return found.groupBy("cell").agg(F.sum(total).alias("v"), F.sum("n").alias("n"))


@dataclass(frozen=True)
class Whitening:
    """The fit: ``n`` vectors with exact sums ``S``, eigenvalues and unit components (columns), and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly: in 64 bits if they hold it, else in numbers of any length."""
        largest = max(self.n * int(np.abs(x).max(initial=0)), *map(abs, self.sums))
        kind = np.int64 if largest < 1 << 61 else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """Centred vectors on the components, each over the root of its eigenvalue."""
        return (deviations / self.n).astype(np.float64) @ (self.components / np.sqrt(self.values))


def fit(vectors: DataFrame, column: str = "embedding", count: int = COMPONENTS) -> Whitening | None:
    """The fit over all usable rows; None if there are none, or all are equal.

    Two passes: exact sums, then the covariance about their mean.  Components without variance are left out.
    """
    ship(vectors.sparkSession)
    read = vectors.select(F.col(column).cast("array<double>"))
    sums = sorted(_cells(read, lambda x: x.sum(axis=0), "long").limit(WIDEST + 1).collect())  # one row for each entry of a vector
    if not sums:
        return None
    if len({r["n"] for r in sums}) > 1:
        raise ValueError("vectors of different lengths")
    if len(sums) > WIDEST:
        raise ValueError(f"vectors of over {WIDEST} entries")
    n, d = sums[0]["n"], len(sums)
    start = Whitening(n, tuple(int(r["v"]) for r in sums), np.ones(1), np.eye(d), 0.0)
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        y = (start.deviations(x) / n).astype(np.float64)
        return (y.T @ y)[upper]

    covariance, cells = np.zeros((d, d)), _cells(read, products, "double").toArrow()  # as many as the covariance has cells
    at = cells["cell"].to_numpy()
    covariance[upper[0][at], upper[1][at]] = cells["v"].to_numpy() / n
    covariance = covariance + np.triu(covariance, 1).T
    trace = float(np.trace(covariance))
    if trace <= 0:
        return None
    values, components = leading(covariance, min(count, d))
    held = values > RANK * values[0]
    return Whitening(n, start.sums, values[held], components[:, held], trace)


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured over all rows."""
    k = len(model.values)
    read = vectors.select(F.col(column).cast("array<double>"))
    means = np.zeros(k)
    for r in _cells(read, lambda x: model.whitened(model.deviations(x)).sum(axis=0), "double").collect():
        means[r["cell"]] = r["v"] / model.n

    def products(x: np.ndarray) -> np.ndarray:
        z = model.whitened(model.deviations(x)) - means
        return (z.T @ z).ravel()

    found = {r["cell"]: r["v"] / model.n for r in _cells(read, products, "double").collect()}
    return float(np.abs(np.array([found[i] for i in range(k * k)]).reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: ``vec_id, component`` (from 1), ``n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the exact squared distance from the mean times ``n`` squared, a decimal without places.  Rows whose vector is null or
    empty or holds null or non-finite entries are left out; null keys and repeated rows stay, and count in the fit as often as they stand;
    other columns are not read.  Vectors of different lengths, of over ``WIDEST`` entries or with entries beyond ``LARGEST / SCALE`` are
    an error.  An empty table, and one whose vectors are all equal, gives no rows.
    """
    model = fit(vectors, column, count)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model, column)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # at most WIDEST numbers for each component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        share = own.values / own.trace
        for batch in batches:
            good, x = _usable(batch.column(1))
            if not len(x):
                continue
            far = own.deviations(x)
            exact = squares(far)
            each = np.repeat(np.arange(len(x)), k)
            keys = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), own.n)), exact.take(pa.array(each)),
                    pa.array(own.whitened(far).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    read = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    return read.mapInArrow(run, schema)
