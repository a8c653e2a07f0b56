"""Connected components by alternating large and small stars: every step is a grouping and a join, none holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracesieve.session import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang a node's neighbours on the least of them and itself: the larger neighbours, or the smaller and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        hung = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For links ``a``-``b`` between numbers: each linked ``node`` and ``root``, the least number of its component.

    Links with a null end, loops and repeated links change nothing; no links give no rows.  The steps are as many as the
    logarithm of the longest chain; each is written to the shared folder, so a lost executor repeats one step only.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    mark = None
    while True:
        now = written(_star(_star(now, True), False), "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if seen == mark or not seen[0]:
            break
        mark = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
