"""Ranks, cuts and running totals with no single-task window over the data.

A seeded md5 order is uniform, so its leading hex digits are balanced range
buckets: rows are ranked inside a bucket and shifted by the bucket's offset.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracesieve.functions.hashing import hash_bucket, hash_order

DIGITS = 3  # 4096 buckets


def hash_rank(df: DataFrame, keys: list[str], seed, by: list[str] = (), dst: str = "shuffle_rank") -> DataFrame:
    """1-based position in the seeded permutation, per ``by`` group if given.

    A group of any size is spread over 4096 buckets.  The offsets table has at most
    4096 rows per group.
    """
    by = list(by)
    d = df.withColumn("_h", hash_order(seed, *keys)).withColumn("_b", hash_bucket(F.col("_h"), DIGITS))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *keys))
    ranked = d.withColumn("_r", inside).join(offsets, [*by, "_b"])
    return ranked.select(*df.columns, (F.col("_r") + F.col("_off")).cast("long").alias(dst))


@dataclass(frozen=True)
class HashCut:
    """The last row, in seeded order, of a head of ``size`` rows out of ``total``."""

    seed: object
    key: str
    size: int
    total: int
    order: str | None

    def head(self) -> Column:
        """True for rows of the head: a plain filter, no shuffle of the rows themselves."""
        if self.order is None:
            return F.lit(False)
        return hash_order(self.seed, self.key) <= self.order  # keys are unique, and so are their hashes


def hash_cut(df: DataFrame, key: str, seed, size: int | None = None, fraction: float | None = None) -> HashCut:
    """Find where the first ``size`` rows (or ``floor(fraction * n)``) of the permutation end.

    Descends by hex digits: each step counts at most 4096 buckets of the one bucket that
    holds the cut, so only counts and one small bucket's keys leave the executors.
    """
    keyed = df.select(hash_order(seed, key).alias("h"), F.col(key).alias("k"))
    prefix, rest, total = "", None, None
    while True:
        inside = keyed.where(F.col("h").startswith(prefix)) if prefix else keyed
        part = F.substring("h", len(prefix) + 1, DIGITS)
        counts = sorted((r[0], r[1]) for r in inside.groupBy(part.alias("b")).count().collect())
        if total is None:
            total = sum(n for _, n in counts)
            size = int(fraction * total) if size is None else min(size, total)
            rest = size
            if size <= 0:
                return HashCut(seed, key, 0, total, None)
        for digits, n in counts:
            if rest <= n:
                break
            rest -= n
        prefix += digits
        if n <= 4096 or len(prefix) >= 30:
            row = keyed.where(F.col("h").startswith(prefix)).orderBy("h", "k").offset(rest - 1).limit(1).first()
            return HashCut(seed, key, size, total, row["h"])


def running_total(df: DataFrame, order: str, columns: list[str], block: int = 65536) -> DataFrame:
    """Cumulative sums of ``columns`` along a non-negative whole-number ``order``, block by block.

    Rows are summed inside a block of ``block`` positions and shifted by the total of earlier
    blocks, so the single-task step sees one row per block.
    """
    d = df.withColumn("_blk", F.floor(F.col(order) / block))
    sums = d.groupBy("_blk").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    earlier = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_blk", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in columns])
    upto = Window.partitionBy("_blk").orderBy(order)
    return d.join(shift, "_blk").select(
        *[c for c in df.columns if c not in columns],
        *[(F.sum(c).over(upto) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in columns],
    )


def round_of_rank(df: DataFrame, n_per_round: int, rank: str = "screen_rank", dst: str = "round") -> DataFrame:
    """Round in which a rank is screened; the last round may be short."""
    return df.withColumn(dst, F.ceil(F.col(rank) / n_per_round).cast("long"))
