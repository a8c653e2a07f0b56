from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesieve.functions import draws
from tracesieve.operators import ranking, sampling, selection
from tracesieve.operators.metrics import best_scale, cumulative_recall


def order(seed, ids):
    return sorted(ids, key=lambda i: (md5(f"{seed}:{i}".encode()).hexdigest(), i))


def test_hash_rank_is_the_md5_permutation(spark):
    got = ranking.hash_rank(spark.range(500).withColumnRenamed("id", "curve_id"), ["curve_id"], 3).collect()
    assert [r["curve_id"] for r in sorted(got, key=lambda r: r["shuffle_rank"])] == order(3, range(500))


@pytest.mark.parametrize("size", [0, 1, 250, 9999, 10000, 20000])
def test_hash_cut_takes_exactly_the_head(spark, size):
    df = spark.range(10000).withColumnRenamed("id", "curve_id")
    cut = ranking.hash_cut(df, "curve_id", 5, size=size)
    got = {r[0] for r in df.where(cut.head()).collect()}
    assert got == set(order(5, range(10000))[:size])
    assert cut.size == min(size, 10000) and cut.total == 10000


def test_hash_cut_descends_when_buckets_are_full(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DIGITS", 1)
    df = spark.range(70000).withColumnRenamed("id", "curve_id")
    cut = ranking.hash_cut(df, "curve_id", 1, fraction=0.8)
    assert df.where(cut.head()).count() == 56000


def test_running_total_over_blocks(spark):
    df = spark.range(1, 101).select(F.col("id").alias("round"), F.col("id").alias("n"))
    got = {r["round"]: r["cum_n"] for r in ranking.running_total(df, "round", ["n"], block=7).collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(1, 101)}


def test_round_of_rank_last_round_short(spark):
    got = ranking.round_of_rank(spark.range(1, 12).withColumnRenamed("id", "screen_rank"), 4).groupBy("round").count()
    assert {r["round"]: r["count"] for r in got.collect()} == {1: 4, 2: 4, 3: 3}


def test_recall_ends(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0)], "round long, y int")
    rows = sorted((r["round"], r["n_screened"], r["frac_screened"], r["recall"]) for r in cumulative_recall(df, (2, 4)).collect())
    assert rows == [(0, 0, 0.0, 0.0), (1, 2, 0.5, 0.5), (2, 3, 0.75, 1.0), (3, 4, 1.0, 1.0), (4, 4, 1.0, 1.0)]


@pytest.mark.parametrize("label", ["y", "y_raw"])
@pytest.mark.parametrize("chunk", [65536, 3], ids=["one chunk", "salted"])
def test_upsample(table, points, label, chunk, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", chunk)
    ids, _, y = points
    labels = y if label == "y_raw" else (y > 0).astype(int)
    got = sampling.upsample(table, label).toPandas()
    assert got[label].value_counts().nunique() == 1
    assert len(got) == np.bincount(labels).max() * len(np.unique(labels))
    assert not got.duplicated(["curve_id", label, "copy_no"]).any()
    source = dict(zip(ids, labels))
    assert all(source[i] == v for i, v in zip(got["curve_id"], got[label]))
    drawn = got.groupby("curve_id").size()
    assert (drawn.loc[ids].to_numpy() == draws.copy_weights(42, ids, labels)).all()


def test_upsample_hot_row(spark):
    """One minority row that stands for a third of the result is met in salted chunks."""
    df = spark.range(3000).select(F.col("id").alias("curve_id"), (F.col("id") == 0).cast("int").alias("y"))
    sampling_chunk, sampling.CHUNK = sampling.CHUNK, 100
    try:
        got = sampling.upsample(df, "y").groupBy("y").count().collect()
    finally:
        sampling.CHUNK = sampling_chunk
    assert {r["y"]: r["count"] for r in got} == {0: 2999, 1: 2999}


@pytest.mark.parametrize("rows", [[(1, 0), (2, 1)], [(1, 1), (2, 1)]], ids=["equal", "single class"])
def test_upsample_nothing_to_add(spark, rows):
    df = spark.createDataFrame(rows, "curve_id long, y int")
    assert sampling.upsample(df, "y").count() == 2


def test_weights(table, points):
    ids, _, y = points
    by_class = {r["y_raw"]: r["w"] for r in sampling.class_weights(table, "y_raw").groupBy("y_raw").agg(F.sum("weight").alias("w")).collect()}
    assert np.allclose(list(by_class.values()), len(ids) / 3)
    got = {r["curve_id"]: r["weight"] for r in sampling.copy_weights(table, "y_raw").collect()}
    assert [got[i] for i in ids] == draws.copy_weights(42, ids, y).tolist()
    assert np.allclose(draws.class_weights(y), [len(y) / (3 * np.bincount(y)[v]) for v in y])


def test_majority_ties_take_the_lowest_label(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (2,), (3,), (3,)], "y_raw int")
    r = sampling.majority_minority(df, "y_raw").first()
    assert (r["majority"], r["n_majority"], r["minority"], r["n_minority"]) == (2, 2, 0, 1)


def test_selection_ties_and_short_batch(spark):
    df = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.1)], "curve_id long, p_bad double")
    assert [r["curve_id"] for r in selection.select_next_batch(df, 2).collect()] == [2, 1]
    assert selection.select_next_batch(df, 10).count() == 3


def test_best_scale_ties(spark):
    df = spark.createDataFrame([(4.0, 0.9), (1.0, 0.9), (0.5, 0.8)], "scale double, accuracy double")
    assert best_scale(df).first()["scale"] == 1.0


def test_unscreened_and_reveal_are_complements(table, monkeypatch):
    chosen = table.where("curve_id % 3 = 0").select("curve_id")
    for limit in (selection.ID_LIMIT, 1):  # broadcast keys, then shuffled keys
        monkeypatch.setattr(selection, "ID_LIMIT", limit)
        left = {r[0] for r in selection.unscreened(table, chosen).select("curve_id").collect()}
        seen = {r[0] for r in selection.reveal(table, chosen).select("curve_id").collect()}
        assert not left & seen and len(left | seen) == 70


def test_checkpoints_are_three(spark):
    with pytest.raises(ValueError, match="three"):
        selection.checkpoint_filter(spark.range(1).withColumnRenamed("id", "n_screened"), (1, 2))
