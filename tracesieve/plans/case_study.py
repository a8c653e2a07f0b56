"""A whole run: load a dataset, make vectors if it has only images, screen, export."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracesieve.operators.blocks import KEY, VEC
from tracesieve.operators.distance import pairwise_distance
from tracesieve.operators.selection import shuffled
from tracesieve.plans.datasets import POOL_SIZE, experiment, simulation
from tracesieve.plans.reporting import chart_tables, report_lines
from tracesieve.plans.screening import Screening, Settings, screen
from tracesieve.session import written
from tracesieve.sinks.models import save_model
from tracesieve.sinks.tables import export_rounds, export_run
from tracesieve.sources.curves import CURVES, TEST_TABLES, dataset_table, load_curves, rejections
from tracesieve.sources.features import featurize


def with_vectors(spark: SparkSession, path: str, dataset: str, test: bool, make_model: Callable | None, size) -> DataFrame:
    """``curve_id, y_raw, x``; vectors come from the images when a model is given."""
    if make_model is None:
        return load_curves(spark, path, dataset, test, [KEY, "y_raw", VEC])
    images = load_curves(spark, path, dataset, test, [KEY, "y_raw", "image"])
    return written(featurize(images, make_model, size).select(KEY, "y_raw", F.col(VEC).cast("array<double>").alias(VEC)), "features")


def run_case_study(
    spark: SparkSession,
    path: str,
    dataset: str = "experiment",
    settings: Settings = Settings(),
    make_model: Callable | None = None,
    size: tuple[int, int] = (224, 224),
    pool_size: int = POOL_SIZE,
    export_path: str | None = None,
    export_distances: bool = False,
) -> Screening:
    """Screen a stored dataset; write everything under ``export_path`` if given.

    Rows that are rejected at load are always counted, in ``rejected`` of the result, and warned of.

    ``export_distances`` adds the full pool x pool and test x pool matrices, quadratic in the
    pool; nothing else needs them.
    """
    curves = with_vectors(spark, path, dataset, False, make_model, size)
    if dataset.lower() == "simulation":
        pool, test = simulation(curves, with_vectors(spark, path, dataset, True, make_model, size))
    else:
        pool, test = experiment(curves, pool_size)
    counts = rejections(spark, path, dataset).collect()  # a row for each table
    for source, n_read, n_rejected in counts:
        if n_rejected:
            warnings.warn(f"{n_rejected} of {n_read} rows of {source} have no key, label or finite vector and are left out", stacklevel=2)
    run = replace(screen(pool, test, settings), rejected={source: (n_read, n_rejected) for source, n_read, n_rejected in counts})
    if export_path:
        export_case_study(run, pool, test, export_path, settings, export_distances)
        export_raw(spark, path, dataset, pool, test, export_path)
        spark.createDataFrame(counts, "source string, n_read long, n_rejected long").write.mode("overwrite").parquet(f"{export_path.rstrip('/')}/general/rejected")
    return run


def export_raw(spark: SparkSession, path: str, dataset: str, pool: DataFrame, test: DataFrame, export_path: str) -> None:
    """The stored arrays and images of pool and test, fetched by key from the curve tables.

    The arrays are joined here once and are never carried through the rounds.
    """
    stored = [f.name for f in CURVES.fields if f.name not in ("x", "y_raw")]
    own_test = dataset.lower() in TEST_TABLES
    for part, rows in (("pool", pool), ("test", test)):
        whole = spark.read.parquet(f"{path.rstrip('/')}/{dataset_table(dataset, own_test and part == 'test')}")
        have = [c for c in stored if c in whole.columns]
        whole.select(have).join(rows.select(KEY), KEY, "left_semi").write.mode("overwrite").parquet(f"{export_path.rstrip('/')}/general/raw_{part}")


def export_case_study(run: Screening, pool: DataFrame, test: DataFrame, path: str, settings: Settings, distances: bool = False) -> None:
    """Inputs, split, rounds, layers, models and figure data of a run as tables."""
    root, spark = path.rstrip("/"), pool.sparkSession
    order = shuffled(pool.select(KEY), seed=settings.shuffle_seed)
    tables = {
        "pool": pool.select(KEY, "y_raw", "y"),
        "test": test.select(KEY, "y_raw", "y"),
        "features": pool.select(KEY, VEC).unionByName(test.select(KEY, VEC)),
        "order": order,
    }
    if distances:
        tables["distance_pool_pool"] = pairwise_distance(pool, pool, settings.l, settings.limits)
        tables["distance_test_pool"] = pairwise_distance(test, pool, settings.l, settings.limits)
    export_run(tables, f"{root}/general")
    rounds = {"rounds": run.rounds, "screened": run.screened, "coefficients": run.coefficients, "confusion": run.confusion}
    n_test = test.count()
    rounds["report"] = report_lines(run, n_test)
    at = {r["n_screened"]: r["round"] for r in run.rounds.select("n_screened", "round").collect()}  # one row per round
    layers = [d.points.withColumn("round", F.lit(at[n])) for n, d in run.discoveries.items() if d.points is not None]
    if layers:
        merged = layers[0]
        for part in layers[1:]:
            merged = merged.unionByName(part, allowMissingColumns=True)
        rounds["layers"] = merged
    for name, kind in (("layer_confusion", "confusion"), ("half_planes", "half_planes")):
        found = [getattr(d, kind).withColumn("round", F.lit(at[n])) for n, d in run.discoveries.items() if getattr(d, kind) is not None]
        if found:
            rounds[name] = reduce(DataFrame.unionByName, found)
    if run.discoveries:
        states = [(at[n], n, d.status) for n, d in run.discoveries.items()]
        rounds["layer_status"] = spark.createDataFrame(states, "round long, n_screened long, status string")
    export_rounds(rounds, f"{root}/rounds", flat=tuple(n for n in rounds if n not in ("screened", "coefficients", "layers")))
    for n, d in run.discoveries.items():
        if d.model is not None:
            save_model(spark, d.model, f"{root}/models/embedding_{n}")
        if d.clusters is not None:
            save_model(spark, d.clusters.centers, f"{root}/models/clusters_{n}")
    for name, table in chart_tables(run).items():
        table.write.mode("overwrite").parquet(f"{root}/charts/{name}")
