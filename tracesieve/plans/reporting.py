"""Composition lines per round and the data behind the figure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracesieve.functions.labels import HELD_OUT
from tracesieve.operators.metrics import COUNTS
from tracesieve.plans.screening import Screening

SETS = ("data   screened", "data unscreened", "data (test set)")  # fixed values: line heads of a report


def round_report(compositions: DataFrame) -> DataFrame:
    """One line per row ``(head, size, n_bad, n_p1, n_p2, n_p3)``."""
    line = F.format_string(
        "%s: %d --> bad curves: %d; P1: %d; P2: %d; P3: %d", "head", "size", *[F.col(c) for c in COUNTS]
    )
    return compositions.withColumn("line", line)


def report_lines(run: Screening, n_test: int) -> DataFrame:
    """The three lines of every round of a run; the test line counts rows predicted good."""
    n = run.totals[1]
    sizes = (F.col("n_screened"), F.lit(n) - F.col("n_screened"), F.lit(n_test).cast("long"))
    sets = [
        F.struct(
            F.lit(i).alias("line_no"), F.lit(head).alias("head"), size.alias("size"), *[F.col(f"{name}_{c}").alias(c) for c in COUNTS]
        )
        for i, (head, size, name) in enumerate(zip(SETS, sizes, ("screened", "unscreened", "test")))
    ]
    rows = run.rounds.select("round", F.inline(F.array(*sets)))
    predicted = F.when(F.col("line_no") == 2, sum(F.col(c) for c in COUNTS))
    return round_report(rows).withColumn("n_predicted_positive", predicted)


def recall_series(progress: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """Recall curve, random-sampling line and perfect-classifier line as ``(series, x, y)``."""
    n_good, n = totals
    curve = F.struct(F.lit("screening").alias("series"), F.col("frac_screened").alias("x"), F.col("recall").alias("y"))
    random = F.struct(F.lit("random").alias("series"), F.col("frac_screened").alias("x"), F.col("frac_screened").alias("y"))
    best = F.least(F.lit(1.0), F.col("frac_screened") * n / max(n_good, 1))
    perfect = F.struct(F.lit("perfect").alias("series"), F.col("frac_screened").alias("x"), best.alias("y"))
    return progress.select(F.inline(F.array(curve, random, perfect)))


def scatter_embedding(points: DataFrame) -> DataFrame:
    """Second-layer scatter: rows predicted good, the held-out class drawn as its own series."""
    good = points.where(F.col("pred") > 0.5)
    return good.select("curve_id", F.col("e0").alias("x"), F.col("e1").alias("y"), "y_raw", (F.col("y_raw") == HELD_OUT).alias("novel"))


def scatter_novelty(points: DataFrame) -> DataFrame:
    """Third-layer scatter: projection against variance, one panel per predicted sign."""
    return points.select(
        "curve_id", F.col("projection").alias("x"), F.col("variance").alias("y"), "y_raw", "pred", (F.col("y_raw") == HELD_OUT).alias("novel")
    )


def chart_tables(run: Screening) -> dict[str, DataFrame]:
    """Every table behind the figure of a run."""
    out = {"recall": recall_series(run.progress(), run.totals)}
    for at, found in run.discoveries.items():
        if found.points is not None:
            out[f"embedding_{at}"] = scatter_embedding(found.points)
            if "variance" in found.points.columns:
                out["novelty"] = scatter_novelty(found.points)
    return out
