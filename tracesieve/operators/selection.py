"""Splits, set growth and choosing the next batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tracesieve.functions.labels import HELD_OUT, holdout_class
from tracesieve.operators.ranking import HashCut, hash_cut, hash_rank

ID_LIMIT = 1_000_000  # keys that may be broadcast for an anti- or semi-join (8 MB)


def shuffled(df: DataFrame, key: str = "curve_id", seed: int = 0) -> DataFrame:
    """The seeded permutation as a ``shuffle_rank`` column."""
    return hash_rank(df, [key], seed)


@dataclass(frozen=True)
class Split:
    pool: DataFrame
    test: DataFrame
    cut: HashCut


def head_split(df: DataFrame, size: int | None = None, fraction: float | None = None, seed: int = 0) -> Split:
    """Pool = head of the shuffled rows without the held-out class, test = the rest of them.

    Both sides are filters on the same scan: no shuffle of the rows.
    """
    known = holdout_class(df)
    cut = hash_cut(known, "curve_id", seed, size, fraction)
    return Split(known.where(cut.head()), known.where(~cut.head()), cut)


def build_test_set(tail: DataFrame, curves: DataFrame) -> DataFrame:
    """The shuffled tail and every row of the held-out class."""
    return tail.unionByName(curves.where(F.col("y_raw") == HELD_OUT).select(*tail.columns))


def train_val_split(df: DataFrame, fraction: float = 0.8, seed: int = 1, key: str = "curve_id") -> DataFrame:
    """Mark the first ``floor(fraction * n)`` rows of the seeded order as ``train``, the rest ``val``."""
    cut = hash_cut(df, key, seed, fraction=fraction)
    return df.withColumn("part", F.when(cut.head(), "train").otherwise("val"))


def _keys(screened: DataFrame, key: str) -> DataFrame:
    """Screened keys, broadcast when their count is small; otherwise the join shuffles."""
    ids = screened.select(key)
    return F.broadcast(ids) if ids.limit(ID_LIMIT + 1).count() <= ID_LIMIT else ids


def unscreened(pool: DataFrame, screened: DataFrame, key: str = "curve_id") -> DataFrame:
    return pool.join(_keys(screened, key), key, "left_anti")


def reveal(pool: DataFrame, chosen: DataFrame, key: str = "curve_id") -> DataFrame:
    """Pool rows of the chosen keys."""
    return pool.join(_keys(chosen, key), key, "left_semi")


def rank_unscreened(scored: DataFrame) -> DataFrame:
    """Likeliest good first; ties by key."""
    return scored.orderBy("p_bad", "curve_id")


def select_next_batch(scored: DataFrame, n: int) -> DataFrame:
    """The next ``n`` rows to label, or fewer when the pool runs out."""
    return rank_unscreened(scored).limit(n)


def grow_screened(screened: DataFrame, chosen: DataFrame) -> DataFrame:
    return screened.unionByName(chosen)


def checkpoint_filter(rounds: DataFrame, checkpoints) -> DataFrame:
    """Rounds at which the embedding layers run, flagged when it is the last one."""
    points = sorted(checkpoints)
    if len(points) != 3:
        raise ValueError("exactly three checkpoints are expected")
    return rounds.where(F.col("n_screened").isin(points)).withColumn("is_last", F.col("n_screened") == points[-1])
