import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation, functions as F

from tracesieve.functions.geometry import signed_projection
from tracesieve.functions.labels import half_plane, recode_labels
from tracesieve.functions.images import tensor
from tracesieve.session import shared_folder
from tracesieve.sinks.archives import export_archives
from tracesieve.sources import archives
from tracesieve.sources.archives import ingest_archives
from tracesieve.sources.curves import load_curves, reject_invalid
from tracesieve.sources.features import featurize

RNG = np.random.default_rng(3)


def archive(path, n, save=np.savez, stub=False, side=4):
    arrays = dict(
        x_raw=RNG.random((n, 1)) if stub else RNG.random((n, 5, 4)),
        y_raw=RNG.integers(0, 4, (n, 1)),
        x_1D_processed=RNG.random((n, 1)) if stub else RNG.random((n, 6, 1)),
        x_2D_processed=RNG.integers(0, 256, (n, side, side)),
    )
    save(path, **arrays)
    return arrays


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_ingest(spark, tmp_path, save):
    first, second = archive(tmp_path / "a.npz", 11, save), archive(tmp_path / "b.npz", 5, save, side=6)
    got = ingest_archives(spark, str(tmp_path / "*.npz"), "Experiment", chunk_bytes=700).orderBy("curve_id").collect()
    assert [r["curve_id"] for r in got] == list(range(16))
    y = np.concatenate([first["y_raw"], second["y_raw"]]).ravel()
    assert [r["y_raw"] for r in got] == [0 if v == 3 else v + 1 for v in y]
    for r, (part, i) in zip(got, [(first, i) for i in range(11)] + [(second, i) for i in range(5)]):
        assert np.allclose([tuple(s) for s in r["x_raw"]], part["x_raw"][i])
        assert np.allclose(r["x_1d"], part["x_1D_processed"][i, :, 0])
        image = part["x_2D_processed"][i].astype(np.uint8)
        assert (r["image"]["height"], r["image"]["width"]) == image.shape and bytes(r["image"]["data"]) == image.tobytes()


class Counted(io.FileIO):
    """A file that counts what is read of it."""

    read_bytes = 0

    def read(self, size=-1):
        got = super().read(size)
        Counted.read_bytes += len(got)
        return got


def test_compressed_bytes_are_inflated_once(tmp_path, monkeypatch):
    """One archive of two hundred ranges: the file is read once, but for its directory, and memory follows a range."""
    arrays = archive(tmp_path / "big.npz", 2000, np.savez_compressed)
    size = (tmp_path / "big.npz").stat().st_size
    monkeypatch.setattr(archives, "_open", lambda path: Counted(path, "rb"))
    task = pa.RecordBatch.from_pydict({"path": [str(tmp_path / "big.npz")], "n_rows": [2000], "step": [10], "first_id": [5]})
    Counted.read_bytes = 0
    made = list(archives._inflated([task]))
    assert [b.num_rows for b in made] == [10] * 200 and size <= Counted.read_bytes < 1.1 * size
    table = pa.Table.from_batches(made)
    assert table["curve_id"].to_pylist() == list(range(5, 2005))
    assert table["y_file"].to_pylist() == arrays["y_raw"].ravel().tolist()
    assert np.array_equal(table["x_1d"].combine_chunks().flatten().to_numpy(), arrays["x_1D_processed"].ravel())


def test_stored_and_compressed_archives_together(spark, tmp_path):
    """Keys follow path order over both kinds; the rows of the inflated ones are read from the shared folder."""
    parts = [archive(tmp_path / f"{name}.npz", n, save) for name, n, save in (("a", 7, np.savez_compressed), ("b", 9, np.savez), ("c", 4, np.savez_compressed))]
    got = ingest_archives(spark, str(tmp_path / "*.npz"), "simulation", chunk_bytes=700)
    for name in "ac":
        (tmp_path / f"{name}.npz").unlink()
    rows = got.orderBy("curve_id").collect()
    assert [r["curve_id"] for r in rows] == list(range(20))
    assert [r["y_raw"] for r in rows] == np.concatenate([p["y_raw"] for p in parts]).ravel().tolist()
    assert np.allclose([r["x_1d"] for r in rows], np.concatenate([p["x_1D_processed"] for p in parts])[:, :, 0])


def test_ingest_stub_arrays_and_simulation_labels(spark, tmp_path):
    arrays = archive(tmp_path / "s.npz", 3, stub=True)
    got = ingest_archives(spark, str(tmp_path / "s.npz"), "simulation").orderBy("curve_id").collect()
    assert [r["y_raw"] for r in got] == arrays["y_raw"].ravel().tolist()
    assert all(r["x_raw"] is None and r["x_1d"] is None for r in got)


def test_exported_archives_are_read_back(spark, tmp_path):
    """Bounded archives, also where one key has most of the rows; positions are keys again in key order."""
    rows = [(i if i % 3 else 40, i % 4, [(float(i), 1.0, 2.0, float(k)) for k in range(5)], [i / 7.0] * 6, (2, 3, bytes([i % 256] * 6))) for i in range(100)]
    table = spark.createDataFrame(rows, "curve_id long, y_file int, x_raw array<struct<time:double,force:double,tip_position:double,contour_length:double>>, x_1d array<double>, image struct<height:int,width:int,data:binary>")
    made = export_archives(table.repartition(4), str(tmp_path / "out"), archive_rows=16).collect()
    assert sum(r["n"] for r in made) == 100 and max(r["n"] for r in made) <= 16 and not list((tmp_path / "out").glob("_*"))
    got = ingest_archives(spark, f"{tmp_path}/out/*.npz", "simulation").orderBy("curve_id").collect()
    key = lambda r: (r[1], [tuple(x) for x in r[2]], r[3], (r[4][0], r[4][1], bytes(r[4][2])))
    assert [r["curve_id"] for r in got] == list(range(100))
    assert sorted(map(key, got)) == sorted(map(key, rows))
    firsts = [r["x_raw"][0]["time"] for r in got]
    keys = [int(f) if int(f) % 3 else 40 for f in firsts]
    assert keys == sorted(keys)
    stubs = table.withColumn("x_raw", F.lit(None).cast(table.schema["x_raw"].dataType)).withColumn("x_1d", F.lit(None).cast("array<double>"))
    export_archives(stubs, str(tmp_path / "stub"))
    assert all(r["x_raw"] is None and r["x_1d"] is None for r in ingest_archives(spark, f"{tmp_path}/stub/*.npz", "simulation").collect())
    assert export_archives(table.where("false"), str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        export_archives(table.withColumn("x_1d", F.slice("x_1d", 1, F.col("y_file") + 1)), str(tmp_path / "bad"))


def test_ingest_refuses_pickled_objects(spark, tmp_path):
    arrays = archive(tmp_path / "o.npz", 2)
    arrays["x_raw"] = np.array([[None], [{}]], dtype=object)
    np.savez(tmp_path / "o.npz", **arrays)
    with pytest.raises(Exception, match="plain row-major"):
        ingest_archives(spark, str(tmp_path / "o.npz"), "experiment").collect()


def test_ingest_refuses_unequal_lengths(spark, tmp_path):
    arrays = archive(tmp_path / "u.npz", 3)
    arrays["y_raw"] = arrays["y_raw"][:2]
    np.savez(tmp_path / "u.npz", **arrays)
    with pytest.raises(Exception, match="differ in length"):
        ingest_archives(spark, str(tmp_path / "u.npz"), "experiment").collect()


def test_load_by_name_and_reject(spark, tmp_path):
    rows = [(1, 0, [1.0]), (2, None, [1.0]), (3, 1, None), (4, 2, [float("nan")]), (None, 1, [1.0]), (5, 7, [1.0]), (6, 3, [2.0])]
    spark.createDataFrame(rows, "curve_id long, y_raw int, x array<double>").write.parquet(str(tmp_path / "simulation_train"))
    seen = Observation("load")
    df = load_curves(spark, str(tmp_path), "Simulation", columns=["curve_id", "y_raw", "x"], observation=seen)
    assert sorted(r["curve_id"] for r in df.collect()) == [1, 6]
    assert seen.get == {"n_read": 7, "n_rejected": 5}
    with pytest.raises(ValueError, match="experiment"):
        load_curves(spark, str(tmp_path), "other")
    with pytest.raises(ValueError, match="no separate test"):
        load_curves(spark, str(tmp_path), "experiment", test=True)


def test_load_refuses_another_schema(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, [1.0])], "curve_id long, label int, x array<double>")
    table.write.parquet(str(tmp_path / "experiment"))
    with pytest.raises(ValueError, match="y_raw int, not None"):
        load_curves(spark, str(tmp_path), "experiment", columns=["curve_id", "y_raw", "x"])
    table.withColumn("y_raw", F.lit("0")).write.parquet(str(tmp_path / "simulation_train"))
    with pytest.raises(ValueError, match="y_raw int, not string"):
        load_curves(spark, str(tmp_path), "simulation", columns=["curve_id", "y_raw", "x"])


def test_ingest_refuses_other_channels(spark, tmp_path):
    arrays = archive(tmp_path / "c.npz", 3)
    arrays["x_raw"] = np.concatenate([arrays["x_raw"]] * 2, axis=2)
    np.savez(tmp_path / "c.npz", **arrays)
    with pytest.raises(Exception, match="channels, not 4"):
        ingest_archives(spark, str(tmp_path / "c.npz"), "experiment").collect()


def test_reject_without_vector(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "curve_id long, y_raw int")
    assert reject_invalid(df, vector=None).count() == 1


def test_recode(spark):
    df = spark.createDataFrame([(v,) for v in range(4)], "y_file int")
    assert [r["y_raw"] for r in recode_labels(df, "EXPERIMENT").orderBy("y_file").collect()] == [1, 2, 3, 0]
    assert [r["y_raw"] for r in recode_labels(df, "simulation").orderBy("y_file").collect()] == [0, 1, 2, 3]


def test_features_match_a_direct_call(spark):
    images = [RNG.integers(0, 256, shape).astype(np.uint8) for shape in ((5, 5), (8, 6), (3, 9))]
    rows = [(i, (im.shape[0], im.shape[1], im.tobytes())) for i, im in enumerate(images)]
    df = spark.createDataFrame(rows, "curve_id long, image struct<height int, width int, data binary>")

    def make():
        return lambda batch: batch.mean(axis=(1, 2))

    got = featurize(df, make, size=(7, 7), batch_size=2).orderBy("curve_id").collect()
    for r, im in zip(got, images):
        want = tensor(im.tobytes(), *im.shape, (7, 7)).mean(axis=(0, 1))
        assert np.allclose(r["x"], want, atol=1e-5)


def test_projection_of_zero_is_on_neither_side(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 1.0, 0.0), (3, -1.0, 0.0)], "curve_id long, e0 double, e1 double")
    centers = spark.createDataFrame([(0, 2.0, 0.0), (1, -2.0, 0.0)], "cluster int, e0 double, e1 double")
    p = signed_projection(df, centers)
    assert {r["curve_id"]: r["projection"] for r in p.collect()} == {1: 0.0, 2: 1.0, 3: -1.0}
    assert [r["curve_id"] for r in half_plane(p, True).collect()] == [2]
    assert [r["curve_id"] for r in half_plane(p, False).collect()] == [3]


def test_shared_folder_is_the_cluster_setting(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
