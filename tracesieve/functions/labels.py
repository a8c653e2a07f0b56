"""Label recoding and label predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BAD, CLASSES, HELD_OUT = 0, (0, 1, 2, 3), 3  # fixed values: 0 bad, 1..3 pathways, 3 kept as novel


def recode_labels(df: DataFrame, dataset: str, src: str = "y_file", dst: str = "y_raw") -> DataFrame:
    """Experiment files number the pathways 0..2 and bad curves 3; simulation files need no change."""
    if dataset.lower() != "experiment":
        return df.withColumn(dst, F.col(src).cast("int"))
    up = F.col(src) + 1
    return df.withColumn(dst, F.when(up == 4, 0).otherwise(up).cast("int"))


def is_good(label: str = "y_raw") -> Column:
    """1 for any pathway, 0 for a bad curve."""
    return (F.col(label) > BAD).cast("int")


def binary_label(df: DataFrame, src: str = "y_raw", dst: str = "y") -> DataFrame:
    return df.withColumn(dst, is_good(src))


def holdout_class(df: DataFrame, label: int = HELD_OUT) -> DataFrame:
    """Training rows only: one class is kept back so that it is new at test time."""
    return df.where(F.col("y_raw") != label)


def positives_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("y_raw") != BAD)


def predicted_sign(df: DataFrame, good: bool, score: str = "pred") -> DataFrame:
    """Rows predicted good (> 0.5) or bad (< 0.5)."""
    return df.where(F.col(score) > 0.5 if good else F.col(score) < 0.5)


def half_plane(df: DataFrame, positive: bool, projection: str = "projection") -> DataFrame:
    """Rows on one side of the bisector; a projection of exactly 0 is on neither."""
    return df.where(F.col(projection) > 0 if positive else F.col(projection) < 0)
