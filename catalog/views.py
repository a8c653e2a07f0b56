"""Curve views over the given ``embeddings`` table, shared by every registered query.

Fixed scores, labels and weights are hashes of the key, written the same way in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracesieve.functions.hashing import hash_order
from tracesieve.operators.ranking import hash_cut
from tracesieve.operators.selection import Split, build_test_set, head_split, train_val_split
from tracesieve.sources.curves import SAMPLE

ROUND_SIZE = 50
SCALE = 8.0
LABEL_BUDGET = 400  # labels are given by hand, so their number does not follow the pool's


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def number(tag: str, *keys) -> Column:
    """A fixed whole number of a key."""
    return F.conv(F.substring(hash_order(tag, *(keys or ("curve_id",))), 1, 8), 16, 10).cast("long")


def weight(tag: str) -> Column:
    """A fixed weight in -1..1 of a key."""
    return (F.pmod(number(tag), F.lit(2001)) - 1000) / 1000.0


def raw_curves(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label")
    y_raw = F.when(label < 6, 0).when(label < 8, 1).when(label == 8, 2).otherwise(3)
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("curve_id"), y_raw.alias("y_raw"), "embedding")


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """``curve_id, y_raw, y, x`` with the planted class signal."""
    planted = F.transform(
        "embedding", lambda v, i: v.cast("double") + F.when(i == 8 * F.col("y_raw"), 1.5).otherwise(0.0)
    )
    return raw_curves(spark, sf).select("curve_id", "y_raw", (F.col("y_raw") > 0).cast("int").alias("y"), planted.alias("x"))


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """``curve_id, y_raw, px``: an 8 x 8 grey image per curve."""
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int"))
    return raw_curves(spark, sf).select("curve_id", "y_raw", px.alias("px"))


def packed(df: DataFrame) -> DataFrame:
    """Pixel arrays packed to image structs."""
    text = F.array_join(F.transform("px", lambda p: F.lpad(F.hex(p), 2, "0")), "")
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(text).alias("data"))
    return df.withColumn("image", image)


def archive_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that array archives hold: labels as stored, 16 samples of four channels, a flat trace, an image."""
    value = lambda i: F.get("embedding", i).cast("double")
    samples = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(*[value(4 * i + c).alias(f.name) for c, f in enumerate(SAMPLE.fields)]))
    stored = F.pmod(F.col("y_raw") + 3, F.lit(4)).cast("int")
    images = packed(pixels(spark, sf)).select("curve_id", "image")
    rows = raw_curves(spark, sf).select("curve_id", stored.alias("y_file"), samples.alias("x_raw"), F.col("embedding").cast("array<double>").alias("x_1d"))
    return rows.join(images, "curve_id")


@dataclass
class Views:
    """The views of one query call; ``budget`` is the most rows that are labelled, None for a quarter of any pool."""

    spark: SparkSession
    sf: str
    budget: int | None = LABEL_BUDGET

    @cached_property
    def curves(self) -> DataFrame:
        return curves(self.spark, self.sf)

    @cached_property
    def split(self) -> Split:
        return head_split(self.curves, fraction=0.8, seed=0)

    @property
    def pool(self) -> DataFrame:
        return self.split.pool

    @cached_property
    def test(self) -> DataFrame:
        return build_test_set(self.split.test, self.curves)

    @cached_property
    def cut(self):
        quarter = hash_cut(self.pool, "curve_id", 0, fraction=0.25)
        return quarter if self.budget is None or quarter.size <= self.budget else hash_cut(self.pool, "curve_id", 0, size=self.budget)

    @property
    def screened(self) -> DataFrame:
        """The labelled rows: a quarter of the pool, and no more than the budget."""
        return self.pool.where(self.cut.head())

    @property
    def rest(self) -> DataFrame:
        return self.pool.where(~self.cut.head())

    @cached_property
    def parts(self) -> DataFrame:
        return train_val_split(self.screened, 0.8, seed=1)

    @property
    def train(self) -> DataFrame:
        return self.parts.where("part = 'train'").drop("part")

    @property
    def val(self) -> DataFrame:
        return self.parts.where("part = 'val'").drop("part")

    @property
    def plane(self) -> DataFrame:
        """Every curve with two coordinates of its vector as a stand-in embedding, and a fixed label."""
        return self.curves.select(
            "curve_id", "y_raw", F.get("x", F.lit(8)).alias("e0"), F.get("x", F.lit(16)).alias("e1"), F.pmod(number("pred"), F.lit(2)).cast("int").alias("pred")
        )

    @property
    def centers(self) -> DataFrame:
        """Mean position of pathway 1 (cluster 0) and pathway 2 (cluster 1)."""
        known = self.plane.where(F.col("y_raw").isin(1, 2))
        return known.groupBy((F.col("y_raw") - 1).alias("cluster")).agg(F.avg("e0").alias("e0"), F.avg("e1").alias("e1"))
