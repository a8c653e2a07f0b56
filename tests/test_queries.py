"""Every registered query beside its SQL twin at the smallest scale."""

import glob
import os
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from catalog import spark_queries
from check import compare

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
SLOW = {"screening_loop", "novelty_discovery"}  # covered end to end in test_screening


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def frame(table):
    return pd.DataFrame({c: pd.Series(table[c].to_pylist(), dtype="object") for c in table.column_names})


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got = frame(entry.queries()[name](spark, SF).toArrow())
    rows = con.execute(SQL[name]).fetchall()
    want = pd.DataFrame(rows, columns=[d[0] for d in con.description], dtype="object")
    assert compare(got, want) == "ok"


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).toArrow().num_rows > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20
    assert [r["p_bad"] for r in rows] == sorted(r["p_bad"] for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_discovery_fits_on_a_quarter_of_any_pool(spark, tmp_path, monkeypatch):
    """Pools of over 1600 rows have more labelled rows than the budget of the queries with an SQL twin."""
    sizes = []
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)] * 9, i % 9) for i in range(2400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))

    def tuned(*sides):
        sizes.extend(side.count() for side in sides)
        return SimpleNamespace(scale=8.0)

    def found(labelled, scored, test, *_, **__):
        sizes.extend((labelled.count(), test.count()))
        return SimpleNamespace(points=labelled.selectExpr("curve_id", "y_raw", "1 as pred", "0.0 as projection", "0.0 as variance"))

    monkeypatch.setattr(spark_queries.classify, "tune_kernel_classifier", tuned)
    monkeypatch.setattr(spark_queries.classify, "score", lambda *_, **__: None)
    monkeypatch.setattr(spark_queries, "discover", found)
    assert entry.queries()["novelty_discovery"](spark, str(tmp_path)).count() == 480
    assert sizes == [384, 96, 480, 480]
