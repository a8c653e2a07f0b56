"""Exact top-k search by inner product: a Voronoi join that skips groups by distance bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracesieve.session import ship, written

#: Fewest and most pivots, and the queries that one pivot is drawn for between them.  They bound all that the driver keeps: a vector
#: and ``k + 1`` distances for each.
PIVOTS, MOST_PIVOTS, PIVOT_QUERIES = 64, 4096, 1024
#: Bytes of the queries and of the data, as doubles, that meet in one task at most, about.
TASK_BYTES = 8 << 20
#: Scores held at a time within a task.
SCORES = 1 << 21
_EXACT = float(1 << 53)
#: Share of a bound by which rounding may move it, with room to spare.
_SLACK = 1e-9


def integral(vector: Column, scale: float = 256.0) -> Column:
    """Each component as ``floor(scale * x)``, a double; null where the vector is null or has a null or non-finite component."""
    doubles = vector.cast("array<double>")
    whole = F.forall(doubles, lambda x: F.coalesce(F.abs(x * F.lit(scale)) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.when(whole, F.transform(doubles, lambda x: F.floor(x * F.lit(scale)).cast("double")))


def _matrix(lists: pa.ListArray, size: int) -> np.ndarray:
    """The lists as rows of ``size`` numbers, short ones filled up with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integral vectors as longs: exact, and held at the ends of the range of long."""
    if len(a) and len(b) and a.shape[1] and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        whole = [[int(x) for x in row] for row in b.tolist()]
        exact = [[sum(int(x) * y for x, y in zip(row, other)) for other in whole] for row in a.tolist()]
        return np.array([[min(max(s, -(1 << 63)), (1 << 63) - 1) for s in row] for row in exact], np.int64)
    return (a @ b.T).astype(np.int64)


def _best(queries: pa.Table, data: pa.Table, k: int, size: int) -> pa.Table:
    """The ``k`` best data rows of each query within one task, of those that reach the query's floor, ties to the smaller key.

    A query's own key takes no part.
    """
    names, at = np.unique(data["vec_id"].to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(names)))
    vectors = _matrix(data["v"].combine_chunks(), size)[order]
    keys, rows, floor = queries["vec_id"].to_numpy(), _matrix(queries["v"].combine_chunks(), size), queries["floor"].to_numpy()
    run, found = max(1, SCORES // max(1, len(vectors))), []
    for i in range(0, len(keys) if len(names) else 0, run):
        own = keys[i : i + run]
        score = np.maximum.reduceat(_products(rows[i : i + run], vectors), starts, axis=1)
        free = (names != own[:, None]) & (score >= floor[i : i + run, None])
        ranked = np.where(free, score, np.iinfo(np.int64).min)
        if len(names) > k:
            least = np.partition(ranked, len(names) - k, axis=1)[:, len(names) - k]
            free &= ranked >= least[:, None]
        q, d = np.nonzero(free)
        s = score[q, d]
        by = np.lexsort((d, -s.astype(np.float64), q)) if np.abs(s).max(initial=0) < _EXACT else np.array(sorted(range(len(q)), key=lambda x: (q[x], -int(s[x]), d[x])), np.int64)
        q, d, s = q[by], d[by], s[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < k
        found.append((own[q[kept]], names[d[kept]], s[kept]))
    parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, parts))))


def _chain(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which each is followed by its nearest that is left."""
    left, order = np.ones(len(centres), bool), [0]
    left[0] = False
    while left.any():
        far = np.where(left, ((centres - centres[order[-1]]) ** 2).sum(axis=1), np.inf)
        order.append(int(far.argmin()))
        left[order[-1]] = False
    return np.array(order)


@dataclass(frozen=True)
class Bounds:
    """The query groups: one for each pivot that is nearest to some query.

    ``floor`` is a score that at least ``k`` other rows reach with every query of the group.  Groups that lie near each other
    share a ``bundle``, which gets one copy of a data row; a bundle of one large group has its queries in several ``blocks``.
    """

    centres: np.ndarray
    radius: np.ndarray
    floor: np.ndarray
    bundle: np.ndarray
    blocks: np.ndarray

    def reached(self, m: np.ndarray) -> np.ndarray:
        """Row by bundle: whether the row can be among the answers of a query there.

        No query within ``radius`` of a centre scores more with a row than the centre does plus ``radius`` times the row's length.
        """
        inner, length = m @ self.centres.T, np.sqrt((m**2).sum(axis=1))[:, None]
        can = inner + length * self.radius + _SLACK * (1 + np.abs(inner) + length * self.radius) >= self.floor
        return np.logical_or.reduceat(can, np.flatnonzero(np.r_[True, np.diff(self.bundle) > 0]), axis=1)

    @staticmethod
    def of(centres: np.ndarray, cells: list[tuple[int, int, float]], close: list[tuple[int, int, float]], k: int, rows: int) -> tuple["Bounds", dict[int, int]]:
        """From summaries: each query group's ``(pivot, queries, radius)``, and ``(key, pivot, distance)`` of the data groups' nearest rows."""
        cells = [cells[i] for i in _chain(centres[[c for c, _, _ in cells]])]
        own = centres[[c for c, _, _ in cells]]
        radius = np.array([r for _, _, r in cells])
        names, at = np.unique(np.array([key for key, _, _ in close]), return_inverse=True)
        pivots, far = centres[[g for _, g, _ in close]], np.array([f for _, _, f in close])
        reach, floor = np.sqrt((pivots**2).sum(axis=1)) + far, np.full(len(cells), -np.inf)
        for i, (c, r) in enumerate(zip(own, radius)):
            if len(names) > k:  # one of the k + 1 best may be the query itself
                inner, length = pivots @ c, np.sqrt(c @ c)
                least = inner - length * far - r * reach
                best = np.full(len(names), -np.inf)
                np.maximum.at(best, at, least - _SLACK * (1 + np.abs(inner) + length * far + r * reach))
                floor[i] = np.partition(best, -k - 1)[-k - 1]
        bundle, held = [], 0
        for _, n, _ in cells:
            fresh = not bundle or held + n > rows
            held = n if fresh else held + n
            bundle.append((bundle[-1] + 1 if bundle else 0) if fresh else bundle[-1])
        queries = np.bincount(bundle, [n for _, n, _ in cells]).astype(np.int64)
        return Bounds(own, radius, floor, np.array(bundle), -(-queries // rows)), {c: i for i, (c, _, _) in enumerate(cells)}


def deal(data: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, pivots: int | None = None) -> tuple[DataFrame, DataFrame, int] | None:
    """The queries and the copies of data rows, each with the ``bundle``, ``block`` and ``part`` in which they meet, and the vectors' width.

    None where there is no query.
    """
    spark = data.sparkSession
    ship(spark)
    rows = data.select(F.col(key).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), integral(F.col(vector), scale).alias("v")).where("vec_id is not null and v is not null")
    sizes = rows.agg(F.max(F.size("v")), F.count_if("asks")).head()
    if not sizes[1]:
        return None
    size, wanted = sizes[0], pivots or min(MOST_PIVOTS, max(PIVOTS, sizes[1] // PIVOT_QUERIES))
    first = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(2 * wanted).select("v").toArrow()
    centres = _matrix(first["v"].combine_chunks(), size)
    centres = centres[np.sort(np.unique(centres, axis=0, return_index=True)[1])[:wanted]]
    own = (centres**2).sum(axis=1)
    step = max(1, SCORES // len(centres))
    per_task = max(1, TASK_BYTES // (8 * max(1, size)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            group, far = [], []
            for a in range(0, batch.num_rows, step):
                m = _matrix(batch.column(2).slice(a, step), size)
                near = np.argmin(own - 2 * m @ centres.T, axis=1)
                group.append(near)
                far.append(np.sqrt(((m - centres[near]) ** 2).sum(axis=1)))
            columns = [pa.array(np.concatenate(x) if x else [], kind) for x, kind in ((group, pa.int64()), (far, pa.float64()))]
            salt = pa.array(np.arange(seen, seen + batch.num_rows))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, salt], names=["vec_id", "asks", "v", "group", "far", "salt"])

    placed = written(rows.mapInArrow(assign, "vec_id long, asks boolean, v array<double>, group long, far double, salt long"), "voronoi")
    asked = placed.where("asks").groupBy("vec_id", "v", "group").agg(F.first("far").alias("far"))
    cells = [tuple(r) for r in asked.groupBy("group").agg(F.count(F.lit(1)), F.max("far")).collect()]
    by_key = placed.groupBy("group", "vec_id").agg(F.min("far").alias("far"))
    nearest = by_key.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("far", "vec_id"))).where(F.col("n") <= k + 1)
    bounds, cell_of = Bounds.of(centres, cells, [tuple(r) for r in nearest.select("vec_id", "group", "far").collect()], k, per_task)
    blocks = bounds.blocks

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(blocks), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                total += bounds.reached(_matrix(batch.column(0).slice(a, step), size)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["bundle", "n"])

    found = dict(tuple(r) for r in placed.select("v").mapInArrow(tally, "bundle long, n long").groupBy("bundle").agg(F.sum("n")).collect())
    parts = np.array([max(1, -(-found.get(b, 0) // per_task)) for b in range(len(blocks))])

    def spans(counts: np.ndarray) -> np.ndarray:
        """0, 1, ... up to each count, one after the other."""
        return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.array([cell_of[g] for g in batch.column(2).to_pylist()], np.int64)
            bundle = bounds.bundle[cell]
            block, copies = batch.column(3).to_numpy() % blocks[bundle], parts[bundle]
            taken = batch.take(pa.array(np.repeat(np.arange(len(cell)), copies)))
            added = [np.repeat(x, copies) for x in (bounds.floor[cell], bundle, block)]
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *map(pa.array, [*added, spans(copies)])], names=["vec_id", "v", "floor", "bundle", "block", "part"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                row, bundle = np.nonzero(bounds.reached(_matrix(some.column(1), size)))
                copies, part = blocks[bundle], some.column(2).to_numpy()[row] % parts[bundle]
                taken = some.take(pa.array(np.repeat(row, copies)))
                added = [np.repeat(bundle, copies), spans(copies), np.repeat(part, copies)]
                yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *map(pa.array, added)], names=["vec_id", "v", "bundle", "block", "part"])

    salted = asked.select("vec_id", "v", "group", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)).alias("salt"))
    meet = "bundle long, block long, part long"
    visits = salted.mapInArrow(visit, f"vec_id long, v array<double>, floor double, {meet}")
    return visits, placed.select("vec_id", "v", "salt").mapInArrow(replicate, f"vec_id long, v array<double>, {meet}"), size


def top_k(data: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """For each row that ``queries`` marks, the ``k`` other rows of highest inner product: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components are first made ``floor(scale * x)``.  Ties go to the smaller key; a query with fewer other rows gets all.
    Rows whose key is null, or whose vector is null or has a null or non-finite component, take no part.  Missing components of
    a shorter vector count as zero.  Rows that share a key are one candidate with their best score, and one query likewise.
    No rows give no rows, and other columns are not read.  Products beyond 2**53 are exact too, at the pace of Python's integers.

    Queries and data both go to their nearest pivot.  A data group's summary is its ``k + 1`` least distances, a query group's
    its radius; they give each query group a score that its queries' k-th answers reach at least.  A data row is copied only to the
    query groups where it can reach that, and is scored there in blocks.  Neighbouring small query groups share a copy.
    Where vectors form no clusters every row reaches every group, and work is queries times rows, as it must be.
    """
    dealt = deal(data, queries, k, key, vector, scale, pivots)
    if dealt is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    visits, copies, size = dealt
    on = ["bundle", "block", "part"]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right if len(right) else left.select(["vec_id", "v"]).slice(0, 0), k, size) if len(left) else _best(right.slice(0, 0).append_column("floor", pa.array([], pa.float64())), right.slice(0, 0), k, size)

    local = visits.groupBy(*on).cogroup(copies.groupBy(*on)).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
