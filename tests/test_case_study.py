import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesieve.operators.embedding import Embedding, Training
from tracesieve.plans.case_study import run_case_study
from tracesieve.plans.screening import Settings
from tracesieve.sinks.models import load_model
from tracesieve.sources.archives import ingest_archives


def archive(path, n, seed, shift):
    """Bright spots at a place that depends on the label."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 4, n)
    image = rng.integers(0, 60, (n, 6, 6))
    image[np.arange(n), y, y] += 190
    stored = (y + 3) % 4 if shift else y
    np.savez(path, x_raw=rng.random((n, 1)), y_raw=stored[:, None], x_1D_processed=rng.random((n, 1)), x_2D_processed=image)


@pytest.mark.parametrize("dataset", ["experiment", "simulation"])
def test_archives_to_exports(spark, tmp_path, dataset):
    def flat():
        return lambda batch: batch[:, :, :, 0].reshape(len(batch), -1)

    shift = dataset == "experiment"
    for name, n, seed in (("experiment", 120, 1),) if shift else (("simulation_train", 80, 2), ("simulation_test", 60, 3)):
        archive(tmp_path / f"{name}.npz", n, seed, shift)
        rows = ingest_archives(spark, str(tmp_path / f"{name}.npz"), dataset)
        rows.unionByName(rows.limit(3).select(F.expr("curve_id + 1000").alias("curve_id"), F.lit(None).cast("int").alias("y_raw"), "x_raw", "x_1d", "image")).write.parquet(str(tmp_path / name))
    out = tmp_path / "out"
    settings = Settings(n_per_round=20, checkpoints=(20, 40, 60), max_rounds=3, kmeans_restarts=1, training=Training(epochs=8, rate=5e-2))
    with pytest.warns(UserWarning, match="3 of 123 rows" if shift else "3 of 83 rows"):
        run = run_case_study(spark, str(tmp_path), dataset.upper(), settings, flat, (6, 6), pool_size=70, export_path=str(out), export_distances=True)
    assert sorted(run.rejected.values()) == ([(123, 3)] if shift else [(63, 3), (83, 3)])
    rounds = run.rounds.orderBy("round").collect()
    assert [r["n_screened"] for r in rounds][:2] == [20, 40]
    assert rounds[-1]["recall"] > 0.8  # the spots are easy to tell
    read = lambda name: spark.read.parquet(str(out / name))
    n_pool = read("general/pool").count()
    assert read("general/order").agg({"shuffle_rank": "max"}).first()[0] == n_pool
    assert read("general/distance_pool_pool").count() == n_pool**2
    assert read("rounds/report").count() == 3 * len(rounds)
    assert read("rounds/layers").select("round").distinct().count() == len(run.discoveries)
    assert {r["status"] for r in read("rounds/layer_status").collect()} == {d.status for d in run.discoveries.values()}
    assert read("rounds/layer_confusion").select("round").distinct().count() == sum(d.confusion is not None for d in run.discoveries.values())
    assert read("general/raw_pool").count() == n_pool and "x_raw" in read("general/raw_test").columns
    assert read("general/rejected").agg({"n_rejected": "sum"}).first()[0] == sum(bad for _, bad in run.rejected.values())
    assert read("charts/recall").where("series = 'screening'").count() == len(rounds) + 2
    assert isinstance(load_model(spark, str(out / "models/embedding_20")), Embedding)
