"""Hard-triplet mining on a labelled set, without emitting its pairs.

A set small enough to broadcast meets itself in one map.  Beyond that, items are grouped by nearest pivot and label, and the triangle
inequality says from a group's least and largest distance to its pivot how near and how far its members can be from an item: an item is
sent only to groups that can hold its farthest same-label or its nearest other-label partner.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracesieve.operators.blocks import KEY, SENT, VEC, Limits, against_anchors, copies, fetch, matrix, power_distance
from tracesieve.session import spread, written

PIVOTS = 128
GROUPS = 65536  # most groups whose four numbers each are broadcast

HARD = T.StructType(
    [
        T.StructField(KEY, T.LongType()),
        T.StructField("pos_id", T.LongType()),
        T.StructField("d_pos", T.DoubleType()),
        T.StructField("neg_id", T.LongType()),
        T.StructField("d_neg", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Groups:
    """Items by nearest pivot and label: the pivots, and for each group its pivot, label, size and least and largest distance to the pivot."""

    pivots: np.ndarray
    pivot: np.ndarray
    label: np.ndarray
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def candidates(self, x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Which groups can hold the farthest same-label or the nearest other-label partner of each row.

        Some member is at the group's least distance from the pivot and some at its largest, which bounds the answer; a group is
        left out only if all its members lie beyond that.  Distances carry rounding, so bounds are loosened by more than that.
        """
        d = np.sqrt(power_distance(x, self.pivots, 2.0))[:, self.pivot]
        slack = 1e-6 * (1.0 + np.sqrt((x * x).sum(axis=1))[:, None] + d)
        same = label[:, None] == self.label[None, :]
        # An item is a member of its own group, at distance 0 of itself: bounds that rest on it are 0 and exclude nothing.
        sure = np.where(same, np.maximum(np.abs(d - self.least), np.abs(self.most - d)), 0.0).max(axis=1)
        far = same & (d + self.most >= sure[:, None] - slack)
        reach = np.where(same, np.inf, d + self.least).min(axis=1)
        near = ~same & (np.maximum(d - self.most, self.least - d) <= reach[:, None] + slack)
        return far | near


def _grouped(items: DataFrame, count: int) -> tuple[DataFrame, Groups] | None:
    """Items with their group number ``g``, and the groups; None if there are too many labels for them."""
    spark = items.sparkSession
    stored = written(spread(items), "triplet-items")
    chosen = matrix(stored.orderBy(F.md5(F.col(KEY).cast("string")), KEY).limit(count).select(VEC).toArrow()[VEC])
    shared = spark.sparkContext.broadcast(chosen)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(power_distance(matrix(batch.column(1)), shared.value, 2.0))
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=[KEY, VEC, "label", "pivot", "d"])

    placed = written(stored.select(KEY, VEC, "label").mapInArrow(assign, T.StructType([*stored.select(KEY, VEC, "label").schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("d", T.DoubleType())])), "triplet-placed")
    found = placed.groupBy("pivot", "label").agg(F.count(F.lit(1)).alias("size"), F.min("d").alias("least"), F.max("d").alias("most")).limit(GROUPS + 1).toArrow()
    if found.num_rows > GROUPS:
        return None
    found = found.sort_by([("pivot", "ascending"), ("label", "ascending")])
    groups = Groups(chosen, *[found[c].to_numpy() for c in ("pivot", "label", "size", "least", "most")])
    numbers = found.select(["pivot", "label"]).append_column("g", pa.array(np.arange(found.num_rows, dtype=np.int64)))
    return placed.join(F.broadcast(spark.createDataFrame(numbers)), ["pivot", "label"]).select(KEY, VEC, "label", "g"), groups


def pairs_met(df: DataFrame, label: str = "y_raw", pivots: int = PIVOTS) -> tuple[int, int]:
    """How many pairs of an item and a partner the groups leave to be measured, and how many there are."""
    members, groups = _grouped(df.select(KEY, F.col(VEC).cast("array<double>").alias(VEC), F.col(label).cast("int").alias("label")), pivots)
    asked = {r["g"]: r["n"] for r in _asking(members, groups).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = int(groups.size.sum())
    return sum(c * int(groups.size[g]) for g, c in asked.items()), n * n


def _asking(members: DataFrame, groups: Groups) -> DataFrame:
    """Every item once for each group ``g`` that can answer it."""
    shared = members.sparkSession.sparkContext.broadcast(groups)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SENT // max(1, len(groups.size)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                row, g = np.nonzero(shared.value.candidates(matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)))
                yield from copies(part, row, g)

    return members.select(KEY, VEC, "label").mapInArrow(ask, members.select(KEY, VEC, "label", "g").schema)


def _by_groups(members: DataFrame, groups: Groups, tile, limits: Limits) -> DataFrame:
    """Candidates from the groups that can hold them; large groups, and groups that many ask, are cut, so that no task is large."""
    spark = members.sparkSession
    asked = {r["g"]: r["n"] for r in _asking(members, groups).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each group
    cuts = [(g, max(1, -(-int(groups.size[g]) // limits.block)), max(1, -(-asked.get(g, 0) // limits.block))) for g in range(len(groups.size))]
    sizes = F.broadcast(spark.createDataFrame(cuts, "g long, blocks int, parts int"))
    block, part = F.pmod(F.xxhash64(KEY), F.col("blocks")), F.pmod(F.xxhash64(KEY), F.col("parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = _asking(members, groups).join(sizes, "g").withColumn("part", part).select(KEY, VEC, "label", "g", "part", every("blocks").alias("block"))
    right = members.join(sizes, "g").withColumn("block", block).select(KEY, VEC, "label", "g", every("parts").alias("part"), "block")
    empty = to_arrow_schema(HARD).empty_table()

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return empty
        q, step = q.sort_by(KEY), max(1, SENT // q.num_rows)
        return pa.concat_tables([tile(p.slice(at, step), q) for at in range(0, p.num_rows, step)])

    return left.groupBy("g", "part", "block").cogroup(right.groupBy("g", "part", "block")).applyInArrow(meet, HARD)


def triplet_hard_pairs(df: DataFrame, label: str = "y_raw", limits: Limits = Limits(), pivots: int = PIVOTS) -> DataFrame:
    """For every item its farthest same-label and nearest other-label partner (null if there is none), ties to the lower key.

    Each block of partners is reduced to one candidate of either kind inside the task that
    sees it, so what leaves is one row per item and block, never the pairs.
    """

    def tile(p: pa.Table, q: pa.Table) -> pa.Table:
        d = np.sqrt(power_distance(matrix(p[VEC]), matrix(q[VEC]), 2.0))
        pid, qid = p[KEY].to_numpy(), q[KEY].to_numpy()
        same = p["label"].to_numpy()[:, None] == q["label"].to_numpy()[None, :]
        partner = same & (pid[:, None] != qid[None, :])
        far, near = np.where(partner, d, -np.inf), np.where(same, np.inf, d)
        at, bt = far.argmax(axis=1), near.argmin(axis=1)
        rows = np.arange(len(pid))
        has_pos, has_neg = partner.any(axis=1), ~same.all(axis=1)
        return pa.table(
            {
                KEY: pid,
                "pos_id": pa.array(qid[at], mask=~has_pos),
                "d_pos": pa.array(d[rows, at], mask=~has_pos),
                "neg_id": pa.array(qid[bt], mask=~has_neg),
                "d_neg": pa.array(d[rows, bt], mask=~has_neg),
            }
        )

    def merge(blocks: DataFrame) -> DataFrame:
        far = F.max(F.when(F.col("pos_id").isNotNull(), F.struct("d_pos", (-F.col("pos_id")).alias("i"))))
        near = F.min(F.when(F.col("neg_id").isNotNull(), F.struct("d_neg", F.col("neg_id").alias("i"))))
        return (
            blocks.groupBy(KEY)
            .agg(far.alias("f"), near.alias("n"))
            .select(KEY, (-F.col("f.i")).alias("pos_id"), F.col("f.d_pos").alias("d_pos"), F.col("n.i").alias("neg_id"), F.col("n.d_neg").alias("d_neg"))
        )

    items = df.select(KEY, F.col(VEC).cast("array<double>").alias(VEC), F.col(label).cast("int").alias("label"))
    table = fetch(items, limits)
    if table is not None:
        return against_anchors(items, table, tile, HARD, limits)
    grouped = _grouped(items, pivots)
    if grouped is None:
        return against_anchors(items, items, tile, HARD, limits, merge)
    return merge(_by_groups(*grouped, tile, limits))


def triplet_terms(hard: DataFrame, margin: float = 1.0) -> DataFrame:
    """Loss term of every item that has an other-label partner; no same-label partner counts as distance 0."""
    gap = F.coalesce("d_pos", F.lit(0.0)) - F.col("d_neg") + margin
    return hard.where(F.col("d_neg").isNotNull()).withColumn("term", F.greatest(gap, F.lit(0.0)))


def triplet_loss(hard: DataFrame, margin: float = 1.0) -> DataFrame:
    return triplet_terms(hard, margin).agg(F.avg("term").alias("loss"), F.count(F.lit(1)).alias("n"))
