"""Fitted models as a coefficient table and a one-row settings table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracesieve.operators.classify import KernelClassifier
from tracesieve.operators.embedding import Embedding


def _anchors(spark: SparkSession, anchors) -> DataFrame:
    return spark.createDataFrame(anchors) if isinstance(anchors, pa.Table) else anchors


def save_model(spark: SparkSession, model: KernelClassifier | Embedding | DataFrame, path: str) -> None:
    """Persist a classifier, an embedding, or a table of cluster centroids."""
    root = path.rstrip("/")
    if isinstance(model, DataFrame):
        kind, rows, values = "centers", model, (0.0, 0.0, 0.0, 0.0)
    elif isinstance(model, KernelClassifier):
        kind, rows = "classifier", _anchors(spark, model.anchors)
        values = (model.scale, model.l, model.intercept, model.accuracy)
    else:
        kind, rows = "embedding", _anchors(spark, model.anchors)
        values = (model.scale, model.l, model.val_loss, float(model.epochs))
    rows.write.mode("overwrite").parquet(f"{root}/rows")
    settings = spark.createDataFrame([(kind, *values)], "kind string, scale double, l double, a double, b double")
    settings.write.mode("overwrite").parquet(f"{root}/settings")


def load_model(spark: SparkSession, path: str) -> KernelClassifier | Embedding | DataFrame:
    root = path.rstrip("/")
    kind, scale, l, a, b = tuple(spark.read.parquet(f"{root}/settings").first())
    rows = spark.read.parquet(f"{root}/rows")
    if kind == "classifier":
        return KernelClassifier(rows, scale, a, l, b)
    return Embedding(rows, scale, l, a, int(b)) if kind == "embedding" else rows
