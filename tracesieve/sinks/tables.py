"""Exports: one parquet table per part of a run, and per-round tables partitioned by round."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_run(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Write inputs, features, split and distances, each as its own table; returns their paths."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def export_rounds(tables: dict[str, DataFrame], path: str, flat: tuple[str, ...] = ()) -> dict[str, str]:
    """Write per-round tables (each with a ``round`` column) partitioned by round.

    Rows are brought together by round, and adaptive execution cuts a round that is larger than its advisory partition size
    into as many tasks and files as it fills, and lets small rounds share a task.
    Tables named in ``flat`` have a few rows for each round and are written as they are.
    """
    out = {}
    for name, df in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        if name in flat:
            df.write.mode("overwrite").parquet(out[name])
        else:
            df.hint("rebalance", "round").write.mode("overwrite").partitionBy("round").parquet(out[name])
    return out
