"""Pool and test set of the two case studies."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracesieve.functions.labels import binary_label, holdout_class
from tracesieve.operators.selection import build_test_set, head_split

POOL_SIZE = 1100  # fixed value: curves of the experiment kept for screening


def experiment(curves: DataFrame, pool_size: int | None = POOL_SIZE, fraction: float | None = None, seed: int = 0):
    """One file: shuffled head without the held-out class, and everything else as test."""
    curves = binary_label(curves)
    split = head_split(curves, None if fraction is not None else pool_size, fraction, seed)
    return split.pool, build_test_set(split.test, curves)


def simulation(train: DataFrame, test: DataFrame):
    """Two files: training curves without the held-out class, and an untouched test file."""
    return holdout_class(binary_label(train)), binary_label(test)
