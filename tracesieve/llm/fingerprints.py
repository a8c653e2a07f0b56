"""SimHash fingerprints of texts, and near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracesieve.llm.batches import text_batches
from tracesieve.llm.components import components
from tracesieve.session import written

BITS = 64
SEED = 42
#: Shingle hashes whose bits are counted at a time.
RUN = 1 << 15
#: Fingerprints of one bucket that are compared in one task; a larger bucket is cut into parts.
CHUNK = 256


def simhash(text: bytes, shingle: int, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text: a bit is set if it is set in over half the hashes of its word shingles, repeats counted.

    A-Z are lower-cased; words are what stands between ASCII white space.  A text of fewer words has one shingle, all of them;
    one of no words has the fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    hashed, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, RUN):
        to = min(n, at + RUN)
        runs = zip(*(words[at + i : to + i] for i in range(shingle))) if len(words) > shingle else [words]
        found = np.array([hashed(x, seed) for x in map(b" ".join, runs)], dtype="<u8")
        total += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, seed: int = SEED, keep: bool = False) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (its 64 bits as a signed long) of every row; a null text is an empty one.

    ``keep`` adds all columns of the input as the struct ``row``.
    """
    text_batches(docs)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([simhash(x.as_py() or b"", shingle, seed) for x in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["doc_id", "fp", "row"][: batch.num_columns])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * keep)
    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *read.schema.fields[2:]])
    return read.mapInArrow(compute, schema)


def covering_masks(radius: int, seed: int = SEED) -> list[int]:
    """Bit masks such that any two fingerprints at most ``radius`` bits apart agree under one of them.

    Each bit gets a vector of ``radius + 1`` random bits; mask ``v``, for each vector but zero, holds the bits whose vectors have an
    odd product with it.  The vectors of ``radius`` differing bits span no more than ``radius`` dimensions, so some ``v`` is at
    right angles to all of them, and its mask leaves those bits out.
    """
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), BITS).tolist()
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(rows: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join those of a few distinct fingerprints which chains of close pairs connect: fewer than fingerprints."""
    n, own = len(rows), rows.view("<u8")
    if n == 2:
        return [(int(rows[0]), int(rows[1]))] if int(own[0] ^ own[1]).bit_count() <= radius else []
    near = np.bitwise_count(own[:, None] ^ own) <= radius
    left, found = np.ones(n, bool), []
    for i in range(n):
        if not left[i]:
            continue
        left[i], front = False, [i]
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            found += [(int(rows[at]), int(rows[j])) for j in new]
            front += new.tolist()
    return found


def fingerprint_links(distinct: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links ``a``-``b`` between distinct fingerprints ``fp``: chains of them join all that lie at most ``radius`` bits apart.

    One table for each covering mask; a bucket holds the fingerprints that agree under the mask.  A bucket of over ``chunk``
    is cut into parts by a hash, and every two parts meet in a task of their own, so no task holds a large bucket and no pair is
    lost.  Each task sends on fewer links than it got fingerprints, never all pairs.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp")))).alias("table", "key"))
    sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    own = keyed.join(sizes, ["table", "key"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = meets.groupBy("table", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).agg(F.collect_list("fp").alias("fps"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
            found = [x for a, b in zip(cuts, cuts[1:]) for x in _links(values[a:b], radius)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tasks.where(F.size("fps") > 1).select("fps").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row: the smallest ``doc_id`` reachable over links of ``radius`` bits or fewer.

    Only ``doc_id`` and ``text`` are read.  A null or blank text has the fingerprint zero and is linked like any other; repeated
    rows stay; a null ``doc_id`` takes part in links, and ``component_id`` is null only where no reachable row has a ``doc_id``.
    Exact copies share a fingerprint and are one node, however many.
    """
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate group, with their columns as they are.

    The row of the smallest ``doc_id`` stays; where several rows have it, the first by their columns' text.  Rows without a ``doc_id``
    stay only where no row of their group has one: one of them then.
    """
    found = written(near_duplicates(docs, shingle, radius, seed), "near-duplicates")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    if again.isEmpty():
        return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    # Rows that share a doc_id, or have none, are told apart by fingerprint and, among equal ones, by their columns.
    same = docs["doc_id"].eqNullSafe(again["doc_id"])
    single = docs.join(again, same, "left_anti").join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    rows = fingerprints(docs.join(again, same, "left_semi"), shingle, seed, keep=True)
    heads = found.groupBy("fp").agg(F.min("component_id").alias("component_id"))
    texts = [F.coalesce(F.col(f"row.`{c}`").cast("string"), F.lit("\0")) for c in docs.columns]
    first = rows.join(heads, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    group = F.coalesce("component_id", "fp"), F.col("component_id").isNull()
    kept = first.groupBy(*group).agg(F.min_by("row", F.sha2(F.concat_ws("\1", *texts), 256)).alias("row"))
    return single.unionByName(kept.select("row.*"))
