"""The curve table: its declared schema, loading by dataset name, rejection of invalid rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

SAMPLE = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("time", "force", "tip_position", "contour_length")]
)
IMAGE = T.StructType(
    [T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())]
)
CURVES = T.StructType(
    [
        T.StructField("curve_id", T.LongType()),
        T.StructField("y_raw", T.IntegerType()),
        T.StructField("x_raw", T.ArrayType(SAMPLE)),
        T.StructField("x_1d", T.ArrayType(T.DoubleType())),
        T.StructField("image", IMAGE),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)
TABLES = {"experiment": "experiment", "simulation": "simulation_train"}  # dataset name -> table folder
TEST_TABLES = {"simulation": "simulation_test"}


def invalid(label: str = "y_raw", vector: str | None = "x") -> Column:
    """A row with no key, no label, or a vector that is missing or holds a missing or non-finite value."""
    bad = F.col("curve_id").isNull() | F.col(label).isNull() | ~F.col(label).isin(0, 1, 2, 3)
    if vector:
        bad = bad | F.col(vector).isNull() | F.exists(
            vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        )
    return F.coalesce(bad, F.lit(True))


def reject_invalid(
    df: DataFrame, observation: Observation | None = None, label: str = "y_raw", vector: str | None = "x"
) -> DataFrame:
    """Drop invalid rows and count them in the same pass (``n_read``, ``n_rejected``)."""
    bad = invalid(label, vector)
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("n_read"), F.count_if(bad).alias("n_rejected"))
    return df.where(~bad)


def rejections(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """``source, n_read, n_rejected`` of each table that a dataset is loaded from, as stored: one pass over keys, labels and vectors."""
    found = []
    for test in (False, True)[: 1 + (dataset.lower() in TEST_TABLES)]:
        table = f"{path.rstrip('/')}/{dataset_table(dataset, test)}"
        rows = spark.read.parquet(table)
        bad = F.count_if(invalid(vector="x" if "x" in rows.columns else None))
        found.append(rows.agg(F.lit(table).alias("source"), F.count(F.lit(1)).alias("n_read"), bad.alias("n_rejected")))
    return reduce(DataFrame.unionByName, found)


def dataset_table(dataset: str, test: bool = False) -> str:
    name = dataset.lower()
    if name not in TABLES:
        raise ValueError(f"unknown dataset {dataset!r}: known are {', '.join(TABLES)}")
    if test and name not in TEST_TABLES:
        raise ValueError(f"{name} has no separate test table")
    return (TEST_TABLES if test else TABLES)[name]


def load_curves(
    spark: SparkSession,
    path: str,
    dataset: str,
    test: bool = False,
    columns: list[str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Curves of a dataset, by case-insensitive name, from parquet under ``path``.

    Only ``columns`` are read (all by default).  A column that the table lacks, or has in another type, is an
    error; invalid rows are rejected and counted in ``observation``.
    """
    fields = [f for f in CURVES.fields if columns is None or f.name in columns]
    table = f"{path.rstrip('/')}/{dataset_table(dataset, test)}"
    df = spark.read.parquet(table)
    stored = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}, not {stored.get(f.name)}" for f in fields if stored.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{table} should have {'; '.join(wrong)}")
    df = df.select(*[f.name for f in fields])
    return reject_invalid(df, observation, vector="x" if "x" in df.columns else None)
