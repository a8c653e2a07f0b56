"""Stateless pseudo-random order and picks from md5, equal on every engine and run."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_order(seed, *keys) -> Column:
    """Hex string that orders rows in a seeded permutation; break ties by the key."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_bucket(order: Column, digits: int, skip: int = 0) -> Column:
    """Leading hex digits as a number: uniform buckets that respect the hash order."""
    return F.conv(F.substring(order, skip + 1, digits), 16, 10).cast("int")


def hash_pick(seed, n: Column, *keys) -> Column:
    """Uniform draw from 0..n-1 (60 hash bits, so the modulo bias stays negligible)."""
    return F.pmod(F.conv(F.substring(hash_order(seed, *keys), 1, 15), 16, 10).cast("long"), n)
