"""Pairs within a distance, without the distance matrix.

The second set is grouped by nearest pivot.  The triangle inequality says from a group's least and largest distance to its pivot whether it
can hold a row's neighbour, so a row is sent only to such groups; work and output follow the neighbours, not the product of both sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tracesieve.operators.blocks import KEY, SENT, VEC, copies, matrix, power_distance
from tracesieve.operators.distance import PAIRS
from tracesieve.session import spread, written

PIVOTS = 128


def kernel_reach(scale: float, least: float) -> float:
    """The distance beyond which ``exp(-d / scale)`` is below ``least``."""
    return -scale * float(np.log(least))


def pairs_within(a: DataFrame, b: DataFrame, reach: float, l: float = 2.0, pivots: int = PIVOTS, block: int = 2048) -> DataFrame:
    """Rows ``(i, j, d)`` for all pairs with ``d <= reach``, where d is the l-norm to the power l, as ``pairwise_distance`` has it.

    The norm is a metric for ``l >= 1``, its power for ``l < 1``.  Groups are cut into blocks, and the rows that ask one into parts, so no
    task is large; bounds are loosened by more than rounding, and every pair is measured before it is kept.  An empty side has no pairs.
    """
    root = 1.0 / max(l, 1.0)
    near = reach**root
    cols = [F.col(KEY), F.col(VEC).cast("array<double>").alias(VEC)]
    stored = written(spread(b.select(*cols)), "nearness")
    spark = stored.sparkSession
    chosen = stored.orderBy(F.md5(F.col(KEY).cast("string")), KEY).limit(pivots).select(VEC).toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], PAIRS)
    shared = spark.sparkContext.broadcast(matrix(chosen[VEC]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = power_distance(matrix(batch.column(1)), shared.value, l) ** root
                g = m.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g), pa.array(m[np.arange(len(g)), g])], names=[KEY, VEC, "g", "m"])

    members = written(stored.mapInArrow(assign, f"{KEY} long, {VEC} array<double>, g long, m double"), "nearness")
    groups = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("least"), F.max("m").alias("most")).toArrow().sort_by("g")  # one row a pivot
    ids, sizes, least, most = (groups[c].to_numpy() for c in ("g", "n", "least", "most"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SENT // len(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                x = matrix(part.column(1))
                m = power_distance(x, shared.value, l)[:, ids] ** root
                slack = 1e-6 * (1.0 + np.sqrt((x * x).sum(axis=1))[:, None] + m)
                row, at = np.nonzero(np.maximum(m - most, least - m) <= near + slack)
                yield from copies(part, row, ids[at])

    asking = spread(a.select(*cols)).mapInArrow(ask, f"{KEY} long, {VEC} array<double>, g long")
    asked = {r["g"]: r["n"] for r in asking.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = [(int(g), -(-int(n) // block), max(1, -(-asked.get(int(g), 0) // block))) for g, n in zip(ids, sizes)]
    table = F.broadcast(spark.createDataFrame(cuts, "g long, blocks long, parts long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(KEY), F.col(n))
    left = asking.join(table, "g").withColumn("part", own("parts")).select(KEY, VEC, "g", "part", every("blocks").alias("block"))
    right = members.join(table, "g").withColumn("block", own("blocks")).select(KEY, VEC, "g", "block", every("parts").alias("part"))
    schema = to_arrow_schema(PAIRS)

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        found, step = [schema.empty_table()], max(1, SENT // max(1, q.num_rows))
        for start in range(0, p.num_rows if q.num_rows else 0, step):
            some = p.slice(start, step)
            d = power_distance(matrix(some[VEC]), matrix(q[VEC]), l)
            i, j = np.nonzero(d <= reach)
            found.append(pa.table({"i": some[KEY].to_numpy()[i], "j": q[KEY].to_numpy()[j], "d": d[i, j]}, schema=schema))
        return pa.concat_tables(found)

    return left.groupBy("g", "part", "block").cogroup(right.groupBy("g", "part", "block")).applyInArrow(meet, PAIRS)
