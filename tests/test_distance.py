import math

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tracesieve.functions.kernels import SCALES, kernel, scale_grid
from tracesieve.operators import blocks
from tracesieve.operators.blocks import Limits
from tracesieve.operators.distance import PAIRS, anchor_features, kernel_expand, pairwise_distance
from tracesieve.operators.nearness import kernel_reach, pairs_within
from tracesieve.operators.triplet import pairs_met, triplet_hard_pairs, triplet_loss, triplet_terms

TILED = Limits(rows=5, passes=0, block=16)  # forces the tiled join on seventy rows
PASSES = Limits(rows=30, passes=9)  # forces several broadcast passes
WAYS = pytest.mark.parametrize("limits", [Limits(), PASSES, TILED], ids=["broadcast", "passes", "tiled"])


def dense(x, l):
    return (np.abs(x[:, None, :] - x[None, :, :]) ** l).sum(axis=2)


@WAYS
@pytest.mark.parametrize("l", [1.0, 1.5, 2.0])
def test_pairwise(table, points, l, limits):
    ids, x, _ = points
    got = pairwise_distance(table, table, l, limits).toPandas()
    assert len(got) == len(ids) ** 2
    m = got.pivot(index="i", columns="j", values="d").loc[ids, ids].to_numpy()
    assert np.allclose(m, dense(x, l), atol=1e-9)
    assert np.allclose(m, m.T) and (m >= 0).all()
    assert np.allclose(np.diag(m), 0, atol=1e-12)


@pytest.mark.parametrize("limits", [PASSES, TILED], ids=["passes", "tiled"])
def test_every_pair_is_met_once_in_whatever_number_of_tasks(spark, table, points, limits):
    ids, x, _ = points
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would else meet in one task
        got = pairwise_distance(table, table.where("curve_id < 140"), 2.0, limits).toPandas()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == len(ids) * 40
    assert np.allclose(got.pivot(index="i", columns="j", values="d").loc[ids, ids[:40]].to_numpy(), dense(x, 2)[:, :40], atol=1e-9)


def test_tiles_shuffle_no_copies_of_vectors(table):
    plan = pairwise_distance(table, table, 2.0, TILED)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan  # blocks are read again from the shared folder, not sent once for each other block


def test_tiles_of_an_empty_side(spark, table):
    for a, b in ((table, table.where("false")), (table.where("false"), table)):
        assert blocks._in_tiles(a.select("curve_id", "x"), b.select("curve_id", "x"), None, PAIRS, TILED).count() == 0


@pytest.mark.parametrize("l", [0.0, -1.0, math.inf, math.nan])
def test_norm_must_be_finite_and_positive(table, l):
    with pytest.raises(Exception, match="finite positive"):
        pairwise_distance(table, table, l).collect()


@WAYS
def test_anchor_features_and_expansion(table, points, limits):
    ids, x, y = points
    anchors = table.where("y_raw < 2")
    inside = y < 2
    k = np.exp(-dense(x, 2)[:, inside] / 2.0)
    got = anchor_features(table, anchors, 2.0, 2.0, limits, keep=["y"]).toPandas().set_index("curve_id").loc[ids]
    assert np.allclose(np.stack(got["features"]), k)
    assert (got["y"].to_numpy() == (y > 0)).all()
    weighted = anchors.select("curve_id", "x", F.array(F.col("curve_id") / 100.0, F.lit(1.0)).alias("w"))
    w = np.column_stack([ids[inside] / 100.0, np.ones(inside.sum())])
    got = kernel_expand(table, weighted, 2.0, 2.0, limits, 2, keep=["y"]).toPandas().set_index("curve_id").loc[ids]
    assert np.allclose(np.stack(got["expansion"]), k @ w)


def test_identical_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0, 4.0])], "curve_id long, x array<double>")
    assert all(abs(r["d"]) < 1e-12 for r in pairwise_distance(df, df).collect())


def test_ragged_vectors_are_an_error(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0])], "curve_id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="equally long"):
        pairwise_distance(df, df).collect()


def test_kernel_and_grid(spark, table):
    k = kernel(pairwise_distance(table, table), 4.0).agg(F.min("k"), F.max("k")).first()
    assert 0 < k[0] <= k[1] <= 1
    assert [r["scale"] for r in scale_grid(spark).orderBy("scale_idx").collect()] == list(SCALES)
    wide = kernel(spark.createDataFrame([([0.0, 4.0],)], "d array<double>"), 4.0).first()["k"]
    assert np.allclose(wide, [1.0, math.exp(-1)])


@WAYS
def test_hard_triplets(table, points, limits):
    ids, x, y = points
    d = np.sqrt(dense(x, 2))
    same = y[:, None] == y[None, :]
    far = np.where(same & ~np.eye(len(y), dtype=bool), d, -1)
    near = np.where(same, np.inf, d)
    got = triplet_hard_pairs(table, limits=limits).toPandas().set_index("curve_id").loc[ids]
    assert np.allclose(got["d_pos"], far.max(axis=1)) and np.allclose(got["d_neg"], near.min(axis=1))
    assert (got["pos_id"].to_numpy() == ids[far.argmax(axis=1)]).all()
    assert (got["neg_id"].to_numpy() == ids[near.argmin(axis=1)]).all()
    loss = triplet_loss(triplet_hard_pairs(table, limits=limits), 0.5).first()
    assert np.isclose(loss["loss"], np.maximum(far.max(axis=1) - near.min(axis=1) + 0.5, 0).mean())


def test_triplets_without_partner(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (2, 2, [3.0])], "curve_id long, y_raw int, x array<double>")
    rows = {r["curve_id"]: r for r in triplet_hard_pairs(df).collect()}
    assert rows[1]["pos_id"] is None and rows[1]["neg_id"] == 2 and np.isclose(rows[1]["d_neg"], 3)
    assert triplet_terms(triplet_hard_pairs(df.where("y_raw = 1"))).count() == 0


def test_hard_triplets_of_planted_clusters_skip_most_pairs(spark):
    rng = np.random.default_rng(12)
    centers = rng.uniform(-20, 20, (24, 3))
    at = rng.integers(0, 24, 1500)
    x, y = centers[at] + rng.normal(0, 0.4, (1500, 3)), at % 4 + 1
    x[100:140], y[100:140] = x[100], y[100]  # copies of one item
    ids = rng.permutation(10_000)[:1500]
    rows = spark.createDataFrame([(int(i), int(c), v.tolist()) for i, c, v in zip(ids, y, x)], "curve_id long, y_raw int, x array<double>").repartition(3)
    met, all_pairs = pairs_met(rows, pivots=48)
    assert all_pairs == 1500**2 and met < 0.35 * all_pairs
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    same = y[:, None] == y[None, :]
    far, near = np.where(same & ~np.eye(1500, dtype=bool), d, -1).max(axis=1), np.where(same, np.inf, d).min(axis=1)
    got = triplet_hard_pairs(rows, limits=Limits(rows=100, block=64), pivots=48).toPandas().set_index("curve_id").loc[ids]
    assert np.allclose(got["d_pos"], far, atol=1e-6) and np.allclose(got["d_neg"], near, atol=1e-6)
    place = {int(i): n for n, i in enumerate(ids)}
    for own, other, want in (("pos_id", True, far), ("neg_id", False, near)):
        to = np.array([place[int(i)] for i in got[own]])
        assert np.allclose(d[np.arange(1500), to], want, atol=1e-6) and (same[np.arange(1500), to] == other).all()


@pytest.mark.parametrize("l, reach", [(2.0, 2.5), (1.0, 2.0), (0.5, 2.2)])
def test_pairs_within_a_distance_are_all_found(spark, l, reach):
    rng = np.random.default_rng(13)
    at = rng.integers(0, 12, 400)
    x = rng.uniform(-15, 15, (12, 3))[at] + rng.normal(0, 0.5, (400, 3))
    x[50:60] = x[50]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "curve_id long, x array<double>").repartition(3)
    d = (np.abs(x[:, None] - x[None]) ** l).sum(axis=2)
    some = rows.where("curve_id < 150")
    got = {(r["i"], r["j"]): r["d"] for r in pairs_within(some, rows, reach, l, pivots=20, block=16).collect()}
    sure = {(i, j) for i in range(150) for j in range(400) if d[i, j] <= reach - 1e-9}
    assert sure <= set(got) and all(d[k] <= reach + 1e-9 and abs(d[k] - v) < 1e-7 for k, v in got.items()) and len(sure) < 150 * 400 / 5
    assert pairs_within(some, rows.limit(0), reach, l).count() == 0 == pairs_within(some.limit(0), rows, reach, l).count()


def test_reach_of_a_kernel():
    assert np.isclose(np.exp(-kernel_reach(8.0, 1e-3) / 8.0), 1e-3)


@pytest.mark.parametrize("operator", ["within", "triplets"])
def test_rows_that_ask_every_group_are_sent_in_small_batches(spark, monkeypatch, operator):
    # one batch of 3000 rows that cannot leave out any group: every row goes to all of them
    n, width, pivots = 3000, 64, 32
    x = np.random.default_rng(15).normal(0, 1, (n, width))
    rows = spark.createDataFrame([(i, i % 2 + 1, v.tolist()) for i, v in enumerate(x)], "curve_id long, y_raw int, x array<double>").coalesce(1)
    sent, real = [], type(rows).mapInArrow

    def seen(df, function, schema):
        def measured(batches):
            for batch in function(batches):
                yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

        if getattr(function, "__name__", "") == "ask":
            sent.extend(real(df, measured, "bytes long, rows long").collect())
        return real(df, function, schema)

    monkeypatch.setattr(type(rows), "mapInArrow", seen)
    if operator == "within":
        pairs_within(rows, rows, 1e3, pivots=pivots)
        copied = n * pivots
    else:
        triplet_hard_pairs(rows, limits=Limits(rows=100), pivots=pivots)
        copied = n * 2 * pivots
    assert sum(r["rows"] for r in sent) >= 0.9 * copied
    assert max(r["bytes"] for r in sent) <= 1.25 * 8 * blocks.SENT < 8 * copied * width / 3
