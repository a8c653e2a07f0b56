"""Whitening against numpy's own eigenvectors and whole-number arithmetic."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracesieve.llm import whitening
from tracesieve.llm.queries import QUERIES
from tracesieve.session import spread


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.asarray(values, float)) @ q.T


SPECTRA = {
    "spread": np.arange(1.0, 41.0),
    "near": 1 + 1e-7 * np.arange(30),
    "wide": 10.0 ** -np.arange(14),
    "equal ones": [3.0] * 4 + [1.0] * 5 + [0.0] * 3,
    "one above": [5.0] + [1.0] * 20,
    "signs": [-3.0, -1.0, 0.0, 2.0, 4.0],
    "one": [2.0],
    "identity": [1.0] * 6,
    "nothing": [0.0] * 4,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_are_eigenvectors(name):
    a = symmetric(SPECTRA[name])
    a = (a + a.T) / 2
    for count in (len(a), min(3, len(a))):
        values, columns = whitening.leading(a, count)
        assert np.allclose(values, np.sort(SPECTRA[name])[::-1][:count], rtol=0, atol=1e-13 * max(1, np.abs(a).max()))
        assert np.abs(a @ columns - columns * values).max() < 1e-13 * max(1, np.abs(SPECTRA[name]).max())
        assert np.abs(columns.T @ columns - np.eye(count)).max() < 1e-13


def test_polar_factor_has_signs_only():
    a = symmetric(np.r_[-(10.0 ** -np.arange(0, 12, 2)), 10.0 ** -np.arange(0, 12, 3)])
    sign = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(sign - (vectors * np.sign(values)) @ vectors.T).max() < 1e-4  # the least are 1e-10 of the largest
    assert np.abs(sign @ sign - np.eye(len(a))).max() < 1e-13


def usable(rows):
    return [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def check(spark, table, count=8):
    rows = usable([(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()])
    got = whitening.whiten(table).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    y = np.array([[(n * e - s) / n for e, s in zip(v, sums)] for v in x])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    keep = values > whitening.RANK * values[0]
    values, vectors = values[keep], vectors[:, keep]
    assert len(got) == n * len(values) and {r["n"] for r in got} == {n}
    exact = Counter((k, sum((n * e - s) ** 2 for e, s in zip(own, sums))) for (k, _), own in zip(rows, x))
    for i in range(len(values)):
        own = [r for r in got if r["component"] == i + 1]
        assert Counter((r["vec_id"], int(r["deviation"])) for r in own) == exact
        assert all(abs(r["explained"] - values[i] / np.trace(v)) < 1e-10 for r in own)
        want = y @ vectors[:, i] / math.sqrt(values[i])
        order = sorted(range(n), key=lambda j: (rows[j][0] is not None, rows[j][0] or 0, sum((n * e - s) ** 2 for e, s in zip(x[j], sums))))
        found = [r["whitened"] for r in sorted(own, key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"]))]
        want = want[order]
        at = np.abs(want).argmax()
        assert np.allclose(found, want * np.sign(want[at] * found[at]), atol=1e-6)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    z = np.array([r["whitened"] for r in sorted(got, key=lambda r: r["component"])]).reshape(len(values), n)
    assert np.allclose((z**2).mean(axis=1), 1, atol=1e-9)
    return got


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist(), 0) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[0][1], 1), (5, rows[5][1], 0), (5, rows[5][1], 0), (901, None, 0), (902, [], 0), (903, [1.0] * 11 + [None], 0), (904, [nan] + [1.0] * 11, 0), (905, [inf] * 12, 0), (906, [1.0, nan], 0), (907, [0.0] * 12, 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("n", F.lit("x")).withColumn("component", F.lit("y")).withColumn("whitened", F.lit(None).cast("int"))
    check(spark, table.cache())


def test_a_third_of_all_rows_are_copies_under_one_key(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(100)] + [(7, [9.0, 1.0, 0.0, 2.0], 0)] * 50
    check(spark, spark.createDataFrame(rows, SCHEMA).repartition(4).cache())


def test_vectors_without_full_rank(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(a), float(b), 0.0], 0) for i, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))]
    got = check(spark, spark.createDataFrame(rows, SCHEMA))
    assert max(r["component"] for r in got) == 2


def test_empty_and_equal_tables(spark):
    for rows in ([], [(1, None, 0)], [(1, [], 0)], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(9)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_what_cannot_be_whitened_is_an_error(spark):
    with pytest.raises(Exception, match="entries|different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA).coalesce(1))
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA).repartition(2, "vec_id"))
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e30], 0), (2, [1.0], 0)], SCHEMA))


def test_deviations_beyond_64_bits_are_exact():
    n, big = 1 << 22, 1 << 40
    model = whitening.Whitening(n, (n * 5, -n * big), np.ones(2), np.eye(2), 2.0)
    far = model.deviations(np.array([[big, big]], np.int64))
    assert far.tolist() == [[n * big - 5 * n, 2 * n * big]]
    assert np.allclose(model.whitened(far), [[big - 5, 2 * big]])


def test_squares_are_exact_at_every_size():
    rng = np.random.default_rng(6)
    for bits in (20, 31, 40, 49, 55):
        far = rng.integers(-(1 << bits), 1 << bits, (7, 64))
        want = [sum(v * v for v in row) for row in far.tolist()]
        assert [int(v) for v in whitening.squares(far).to_pylist()] == want
        assert [int(v) for v in whitening.squares(far.astype(object)).to_pylist()] == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_embedding_whitening"](spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    want = check(spark, spread(spark.read.parquet(f"{sf}/embeddings.parquet")))
    assert Counter((r["vec_id"], r["component"], r["deviation"]) for r in got.collect()) == Counter((r["vec_id"], r["component"], int(r["deviation"])) for r in want)
