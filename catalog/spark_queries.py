"""The registered Spark queries: one per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.views import ROUND_SIZE, SCALE, Views, archive_rows, number, packed, pixels, r6, weight
from tracesieve.functions import images, labels
from tracesieve.functions.geometry import midpoint_normal, signed_projection
from tracesieve.functions.kernels import SCALES, kernel, kernel_means
from tracesieve.operators import classify, clusters, distance, embedding, metrics, nearness, ranking, sampling, selection, triplet, variance
from tracesieve.plans import reporting
from tracesieve.plans.discovery import discover, novelty_table
from tracesieve.plans.screening import Settings, screen
from tracesieve.session import ship, work_path
from tracesieve.sinks.models import load_model, save_model
from tracesieve.sinks.archives import export_archives
from tracesieve.sinks.tables import export_rounds, export_run
from tracesieve.sources.archives import ingest_archives
from tracesieve.sources.curves import load_curves
from tracesieve.sources.features import featurize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(Views(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def text(px) -> F.Column:
    return F.array_join(F.transform(px, lambda p: p.cast("string")), ",").alias("px")


def p_bad():
    return (F.pmod(number("score"), F.lit(1000)) / 1000.0).alias("p_bad")


def pred():
    return F.pmod(number("pred"), F.lit(2)).cast("int")


# sources and sinks


@query
def load_curves_query(v: Views) -> DataFrame:
    folder = work_path(v.spark, "dataset")
    v.curves.select("curve_id", "y_raw", "x").write.parquet(f"{folder}/experiment")
    loaded = load_curves(v.spark, folder, "Experiment", columns=["curve_id", "y_raw", "x"])
    total = F.aggregate("x", F.lit(0.0), lambda s, a: s + a)
    return loaded.select("curve_id", "y_raw", F.size("x").alias("n_dims"), r6(total).alias("x_sum"))


@query
def ingest_array_archives(v: Views) -> DataFrame:
    folder = work_path(v.spark, "archives")
    export_archives(archive_rows(v.spark, v.sf), folder)
    got = ingest_archives(v.spark, f"{folder}/*.npz", "experiment")
    return got.select(
        "curve_id",
        "y_raw",
        F.size("x_raw").alias("n_samples"),
        r6(F.get("x_raw", F.lit(0))["force"]).alias("first_force"),
        r6(F.get("x_raw", F.lit(15))["contour_length"]).alias("last_contour"),
        r6(F.aggregate("x_1d", F.lit(0.0), lambda s, a: s + a)).alias("x_sum"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.hex("image.data").alias("image_hex"),
    )


@query
def feature_from_images(v: Views) -> DataFrame:
    """A toy network stands in for the model: how many inputs of each channel are above the channel mean."""

    def count_bright():
        return lambda batch: (batch > 0).sum(axis=(1, 2)).astype(np.float32)

    got = featurize(packed(pixels(v.spark, v.sf)), count_bright, size=(12, 12))
    return got.select("curve_id", *[F.get("x", F.lit(i)).cast("double").alias(f"f{i}") for i in range(3)])


@query
def export_run_query(v: Views) -> DataFrame:
    split = v.pool.select("curve_id", "y_raw", F.lit("pool").alias("part")).unionByName(
        v.test.select("curve_id", "y_raw", F.lit("test").alias("part"))
    )
    tables = {
        "curves": v.curves.select("curve_id", "y_raw", "y"),
        "features": v.curves.select("curve_id", "x"),
        "split": split,
        "distances": distance.anchor_features(v.test, v.screened, keep=["y_raw"]),
    }
    paths = export_run(tables, work_path(v.spark, "run"))
    read = {name: v.spark.read.parquet(path) for name, path in paths.items()}
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda s, a: s + a) / F.size(c))
    rows = {
        "curves": (F.col("y_raw").cast("string"), F.col("y").cast("double")),
        "features": (F.size("x").cast("string"), total("x")),
        "split": (F.concat_ws(" ", "part", "y_raw"), F.lit(None).cast("double")),
        "distances": (F.concat_ws(" ", F.size("features"), "y_raw"), total("features")),
    }
    parts = [read[name].select(F.lit(name).alias("part_of_run"), "curve_id", said.alias("said"), value.alias("value")) for name, (said, value) in rows.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def export_rounds_query(v: Views) -> DataFrame:
    rounds = ranking.round_of_rank(selection.shuffled(v.pool.select("curve_id", "y_raw")), ROUND_SIZE, "shuffle_rank")
    rows = rounds.join(v.plane.select("curve_id", "pred", "e0", "e1"), "curve_id").select(
        "round", "curve_id", "y_raw", (F.col("pred") == 1).alias("predicted_good"), r6("e0").alias("e0"), r6("e1").alias("e1")
    )
    path = export_rounds({"embedding": rows}, work_path(v.spark, "rounds"))["embedding"]
    return v.spark.read.schema(rows.schema).parquet(path)


@query
def save_model_query(v: Views) -> DataFrame:
    anchors = v.screened.select("curve_id", "x", F.array(weight("coef")).alias("w"))
    path = work_path(v.spark, "model")
    save_model(v.spark, classify.KernelClassifier(anchors, SCALE, 0.25, 2.0, 1.0), path)
    model = load_model(v.spark, path)
    return model.anchors.select(
        "curve_id", F.get("w", F.lit(0)).alias("w"), F.lit(model.scale).alias("scale"), F.lit(model.intercept).alias("intercept")
    )


@query
def round_report(v: Views) -> DataFrame:
    sets = (
        v.screened.select(F.lit(0).alias("line_no"), "y_raw", F.lit(True).alias("shown"))
        .unionByName(v.rest.select(F.lit(1).alias("line_no"), "y_raw", F.lit(True).alias("shown")))
        .unionByName(v.test.select(F.lit(2).alias("line_no"), "y_raw", (pred() == 1).alias("shown")))
    )
    bins = [F.count_if(F.col("shown") & (F.col("y_raw") == i)).alias(c) for i, c in enumerate(metrics.COUNTS)]
    counted = sets.groupBy("line_no").agg(*bins, F.count(F.lit(1)).alias("size"), F.count_if("shown").alias("n_counted"))
    heads = F.array(*[F.lit(h) for h in reporting.SETS])
    lines = reporting.round_report(counted.withColumn("head", F.get(heads, F.col("line_no"))))
    return lines.select("line_no", "line", "n_counted")


def _progress(v: Views) -> tuple[DataFrame, tuple[int, int]]:
    ranked = ranking.round_of_rank(selection.shuffled(v.pool.select("curve_id", "y")), ROUND_SIZE, "shuffle_rank")
    totals = tuple(metrics.positive_totals(v.pool).first())
    return metrics.cumulative_recall(ranked.select("round", "y"), totals), totals


@query
def chart_tables(v: Views) -> DataFrame:
    series = reporting.recall_series(*_progress(v)).withColumn("curve_id", F.lit(None).cast("long"))
    plane = reporting.scatter_embedding(v.plane).withColumn("series", F.lit("embedding"))
    placed = signed_projection(v.plane, v.centers).withColumn("variance", p_bad())
    novelty = reporting.scatter_novelty(placed).withColumn("series", F.lit("novelty"))
    shown = ["series", "curve_id", "x", "y"]
    rows = series.select(shown).unionByName(plane.select(shown)).unionByName(novelty.select(shown))
    return rows.select("series", "curve_id", r6("x").alias("x"), r6("y").alias("y"))


# projections


@query
def recode_labels(v: Views) -> DataFrame:
    filed = v.curves.select("curve_id", F.pmod(F.col("y_raw") + 3, F.lit(4)).cast("int").alias("y_file"))
    return labels.recode_labels(filed, "Experiment")


@query
def binary_label(v: Views) -> DataFrame:
    return labels.binary_label(v.curves.select("curve_id", "y_raw"))


@query
def invert_image(v: Views) -> DataFrame:
    return pixels(v.spark, v.sf).select("curve_id", text(images.invert_image(F.col("px"))))


@query
def replicate_channels(v: Views) -> DataFrame:
    return pixels(v.spark, v.sf).select("curve_id", text(images.replicate_channels(F.col("px"))))


@query
def resize_nearest(v: Views) -> DataFrame:
    return pixels(v.spark, v.sf).select("curve_id", text(images.resize_nearest(F.col("px"), (8, 8), (12, 12))))


@query
def normalize_channels(v: Views) -> DataFrame:
    grey = images.replicate_channels(images.invert_image(F.col("px")))
    values = pixels(v.spark, v.sf).select("curve_id", images.normalize_channels(grey).alias("c"))
    return values.select("curve_id", F.posexplode("c").alias("pos", "v")).withColumn("v", r6("v"))


@query
def rbf_kernel(v: Views) -> DataFrame:
    pairs = kernel(distance.pairwise_distance(v.test, v.screened), SCALE)
    return pairs.select("i", "j", r6("k").alias("k"))


@query
def scale_grid(v: Views) -> DataFrame:
    means = kernel_means(distance.pairwise_distance(v.test, v.screened))
    return means.withColumn("mean_k", r6("mean_k"))


@query
def embed_project(v: Views) -> DataFrame:
    anchors = labels.positives_only(v.screened).select("curve_id", "x", F.array(weight("w0"), weight("w1")).alias("w"))
    out = embedding.embed_project(v.test, embedding.Embedding(anchors, SCALE, 2.0, 0.0, 0))
    return out.select("curve_id", r6("e0").alias("e0"), r6("e1").alias("e1"))


def _projected(v: Views) -> DataFrame:
    return signed_projection(v.plane, v.centers)


@query
def signed_projection_query(v: Views) -> DataFrame:
    return _projected(v).select("curve_id", r6("projection").alias("projection"))


@query
def centroid_midpoint_normal(v: Views) -> DataFrame:
    return midpoint_normal(v.centers).select(*[r6(c).alias(c) for c in ("m0", "m1", "n0", "n1")])


# filters


@query
def holdout_class(v: Views) -> DataFrame:
    return labels.holdout_class(v.curves).select("curve_id", "y_raw")


@query
def positives_only(v: Views) -> DataFrame:
    return labels.positives_only(v.pool).select("curve_id", "y_raw")


@query
def predicted_sign_filter(v: Views) -> DataFrame:
    sides = [labels.predicted_sign(v.plane, good).select("curve_id", "y_raw", F.lit(name).alias("side")) for good, name in ((True, "good"), (False, "bad"))]
    return sides[0].unionByName(sides[1])


@query
def half_plane_filter(v: Views) -> DataFrame:
    p = _projected(v)
    sides = [labels.half_plane(p, up).select("curve_id", "y_raw", F.lit(name).alias("side")) for up, name in ((True, "positive"), (False, "negative"))]
    return sides[0].unionByName(sides[1])


@query
def checkpoint_filter(v: Views) -> DataFrame:
    ranked = ranking.round_of_rank(selection.shuffled(v.pool.select("curve_id")), ROUND_SIZE, "shuffle_rank")
    rounds = ranked.groupBy("round").agg(F.max("shuffle_rank").alias("n_screened"))
    return selection.checkpoint_filter(rounds, (300, 50, 150))


# joins


@query
def pairwise_distance_self(v: Views) -> DataFrame:
    return distance.pairwise_distance(v.curves, v.curves).withColumn("d", r6("d"))


@query
def pairwise_distance_cross(v: Views) -> DataFrame:
    return distance.pairwise_distance(v.test, v.pool).withColumn("d", r6("d"))


@query
def pairwise_distance_within(v: Views) -> DataFrame:
    """Pairs whose kernel value at a scale of 1 is at least a quarter: neighbours, without the matrix."""
    return nearness.pairs_within(v.curves, v.curves, nearness.kernel_reach(1.0, 0.25)).withColumn("d", r6("d"))


@query
def anchor_features(v: Views) -> DataFrame:
    got = distance.anchor_features(v.pool, v.train)
    return got.select("curve_id", F.posexplode("features").alias("pos", "d")).withColumn("d", r6("d"))


@query
def unscreened(v: Views) -> DataFrame:
    return selection.unscreened(v.pool, v.screened).select("curve_id", "y_raw")


@query
def reveal_labels(v: Views) -> DataFrame:
    return selection.reveal(v.pool.select("curve_id", "y_raw", "y"), v.screened)


@query
def triplet_hard_pairs(v: Views) -> DataFrame:
    hard = triplet.triplet_hard_pairs(labels.positives_only(v.curves))
    return hard.withColumn("d_pos", r6("d_pos")).withColumn("d_neg", r6("d_neg"))


# aggregations


@query
def composition(v: Views) -> DataFrame:
    part = lambda df, name: df.select(F.lit(name).alias("part"), "y_raw")
    sets = part(v.screened, "screened").unionByName(part(v.rest, "unscreened"))
    return metrics.composition(sets.unionByName(part(v.test.where(pred() == 1), "test")), "part")


@query
def class_counts(v: Views) -> DataFrame:
    return sampling.majority_minority(v.pool, "y_raw")


def _guesses(v: Views) -> DataFrame:
    """A fixed guess per pool row and grid scale."""
    grid = F.array(*[F.struct(F.lit(i).alias("scale_idx"), F.lit(s).alias("scale")) for i, s in enumerate(SCALES)])
    rows = v.pool.select("curve_id", "y", F.inline(grid))
    return rows.withColumn("pred", F.pmod(number("guess", "scale_idx", "curve_id"), F.lit(2)).cast("int"))


@query
def validation_accuracy(v: Views) -> DataFrame:
    return metrics.validation_accuracy(_guesses(v)).withColumn("accuracy", r6("accuracy"))


@query
def confusion_classifier(v: Views) -> DataFrame:
    return metrics.confusion_classifier(v.plane)


def _clustered(v: Views) -> DataFrame:
    return clusters.nearest_centroid(v.plane, v.centers)


@query
def confusion_clusters(v: Views) -> DataFrame:
    return metrics.confusion_clusters(_clustered(v).where("pred = 1"))


@query
def confusion_half_planes(v: Views) -> DataFrame:
    return metrics.confusion_half_planes(_projected(v))


@query
def triplet_hard_mining(v: Views) -> DataFrame:
    loss = triplet.triplet_loss(triplet.triplet_hard_pairs(labels.positives_only(v.curves)))
    return loss.withColumn("loss", r6("loss"))


@query
def cluster_alignment(v: Views) -> DataFrame:
    return metrics.cluster_alignment(metrics.confusion_clusters(_clustered(v).where("pred = 1")))


@query
def positive_totals(v: Views) -> DataFrame:
    return metrics.positive_totals(v.pool)


@query
def label_counts(v: Views) -> DataFrame:
    return metrics.label_counts(v.curves)


# windows


@query
def cumulative_recall(v: Views) -> DataFrame:
    steps, _ = _progress(v)
    return steps.withColumn("frac_screened", r6("frac_screened")).withColumn("recall", r6("recall"))


@query
def train_val_split(v: Views) -> DataFrame:
    return selection.train_val_split(v.pool, 0.8, seed=1).select("curve_id", "part")


@query
def round_of_rank(v: Views) -> DataFrame:
    ranked = selection.shuffled(v.pool.select("curve_id")).withColumnRenamed("shuffle_rank", "screen_rank")
    return ranking.round_of_rank(ranked, ROUND_SIZE)


# sorts


@query
def seeded_shuffle(v: Views) -> DataFrame:
    return selection.shuffled(v.curves.select("curve_id"))


@query
def rank_unscreened(v: Views) -> DataFrame:
    return selection.rank_unscreened(v.rest.select("curve_id", p_bad()))


@query
def select_next_batch(v: Views) -> DataFrame:
    return selection.select_next_batch(v.rest.select("curve_id", p_bad()), 20)


@query
def best_scale(v: Views) -> DataFrame:
    scores = metrics.validation_accuracy(_guesses(v)).withColumn("accuracy", F.round("accuracy", 1))
    return metrics.best_scale(scores)


@query
def head_split(v: Views) -> DataFrame:
    return labels.holdout_class(v.curves).select("curve_id", v.split.cut.head().alias("in_pool"))


# sets


@query
def build_test_set(v: Views) -> DataFrame:
    return v.test.select("curve_id", "y_raw")


@query
def grow_screened(v: Views) -> DataFrame:
    chosen = selection.select_next_batch(v.rest.select("curve_id", "y_raw", p_bad()), 20)
    part = lambda df, name: df.select("curve_id", "y_raw", F.lit(name).alias("part"))
    return selection.grow_screened(part(v.screened, "screened"), part(chosen, "chosen"))


@query
def append_resampled(v: Views) -> DataFrame:
    grown = sampling.upsample(v.pool.select("curve_id", "y"), "y").select("curve_id", "copy_no")
    return ranking.hash_rank(grown, ["curve_id", "copy_no"], 0)


# rebalancing


@query
def upsample_binary(v: Views) -> DataFrame:
    return sampling.upsample(v.pool.select("curve_id", "y"), "y")


@query
def upsample_multiclass(v: Views) -> DataFrame:
    return sampling.upsample(v.pool.select("curve_id", "y_raw"), "y_raw")


@query
def class_weights(v: Views) -> DataFrame:
    return sampling.class_weights(v.pool.select("curve_id", "y_raw"), "y_raw").withColumn("weight", r6("weight"))


# learning


def _weighted(v: Views) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows weighted as their upsampled copies would be."""
    return sampling.copy_weights(v.train, "y"), sampling.copy_weights(v.val, "y")


@query
def fit_kernel_classifier(v: Views) -> DataFrame:
    train, _ = _weighted(v)
    features = distance.anchor_features(train, v.train, scale=1.0, keep=["y", "weight"])
    model = classify.fit_kernel_classifier(features, weight="weight")
    found = classify.with_weights(v.train.select("curve_id", "x"), model.coefficients.toArray())
    return found.select("curve_id", r6(F.get("w", F.lit(0))).alias("w"), r6(F.lit(float(model.intercept))).alias("intercept"))


@query
def scale_grid_search(v: Views) -> DataFrame:
    grid = classify.scale_grid_search(*_weighted(v))
    return grid.select("scale_idx", "scale", r6("accuracy").alias("accuracy"), r6("intercept").alias("intercept"))


@query
def score_probability(v: Views) -> DataFrame:
    anchors = v.screened.select("curve_id", "x", F.array(weight("coef")).alias("w"))
    points = v.rest.select("curve_id", "x").unionByName(v.test.select("curve_id", "x"))
    got = classify.score(points, classify.KernelClassifier(anchors, SCALE, 0.25, 2.0, 0.0))
    return got.select("curve_id", r6("p_bad").alias("p_bad"), r6("p_good").alias("p_good"), "pred")


@query
def screening_loop(v: Views) -> DataFrame:
    run = screen(v.pool, v.test, Settings(n_per_round=ROUND_SIZE), layers=False)
    return run.rounds.select(
        "round", "n_screened", r6("frac_screened").alias("frac_screened"), r6("recall").alias("recall"), "scale", r6("accuracy").alias("accuracy"), "status"
    )


#: A stated number of steps, which SQL can follow; slow ones, so that triplets are left to learn from.
STATED = embedding.Training(epochs=2, rate=1e-4)


#: Few epochs of larger steps: each epoch is a pass over the cluster.
BRIEF = embedding.Training(epochs=16, rate=1e-2)


def _embedding(v: Views):
    sides = [sampling.copy_weights(labels.positives_only(d).select("curve_id", "x", "y_raw"), "y_raw") for d in (v.train, v.val)]
    return embedding.fit_metric_embedding(*sides, SCALE, t=STATED)


@query
def fit_metric_embedding(v: Views) -> DataFrame:
    found = _embedding(v)
    anchors = v.spark.createDataFrame(found.anchors) if not isinstance(found.anchors, DataFrame) else found.anchors
    return anchors.select("curve_id", r6(F.get("w", F.lit(0))).alias("w0"), r6(F.get("w", F.lit(1))).alias("w1"), r6(F.lit(found.val_loss)).alias("val_loss"))


@query
def kmeans_two(v: Views) -> DataFrame:
    found = clusters.kmeans_two(v.plane.where("pred = 1"))
    return found.centers.select("cluster", r6("e0").alias("e0"), r6("e1").alias("e1"), r6(F.lit(found.cost)).alias("cost"))


@query
def nearest_centroid(v: Views) -> DataFrame:
    return _clustered(v).select("curve_id", "cluster")


@query
def posterior_variance(v: Views) -> DataFrame:
    return variance.posterior_variance(v.test, v.pool, SCALE).withColumn("variance", r6("variance"))


def _class_means(v: Views) -> DataFrame:
    """Two anchors, the mean vectors of bad and good pool rows, where the formula has a closed form."""
    parts = v.pool.select("y", F.posexplode("x").alias("pos", "v")).groupBy("y", "pos").agg(F.avg("v").alias("v"))
    wide = parts.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))  # one value per vector position
    means = wide.select(F.col("y").cast("long").alias("curve_id"), F.transform("p", lambda s: s["v"]).alias("x"))
    return variance.posterior_variance(v.test, means, SCALE).withColumn("variance", r6("variance"))


@query
def posterior_variance_class_means(v: Views) -> DataFrame:
    return _class_means(v)


@query
def novelty_table_query(v: Views) -> DataFrame:
    """The view over a fixed plane and fixed labels, so that SQL can follow it."""
    return novelty_table(_projected(v).join(_class_means(v), "curve_id")).withColumn("projection", r6("projection"))


@query
def novelty_discovery(v: Views) -> DataFrame:
    """The view over layers that are all fitted, on a quarter of any pool: classifier, embedding, clusters and variance."""
    v = replace(v, budget=None)
    train, val = _weighted(v)
    model = classify.tune_kernel_classifier(train, val)
    scored = classify.score(v.test, model, keep=["y_raw", "x"])
    found = discover(v.screened, scored, v.test, v.pool, model.scale, last=True, training=BRIEF)
    return novelty_table(found.points)


for _name in ("load_curves", "export_run", "export_rounds", "save_model", "signed_projection", "novelty_table"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_query")
