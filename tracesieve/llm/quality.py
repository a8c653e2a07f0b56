"""Quality classifier: a factorisation machine over hashed words, structure statistics and the stated length."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tracesieve.llm.batches import text_batches
from tracesieve.session import written

#: Labelled rows that a model is fitted on at most, the first by a hash of their key: the bound of the fit.
SAMPLE = 6000
#: Bytes of their features that the driver fits on at most: rows beyond are left out of the fit.
SAMPLE_BYTES = 96 << 20
#: Buckets of hashed words.
WORDS = 1 << 16
FACTORS = 4
THRESHOLD = 0.7
#: Bytes of text whose features are counted at a time.
SLICE = 2 << 20

# The bins of a share between 0 and 1, and the classes of bytes whose shares are statistics.
_BINS = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.75])
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:'\"-()", b"!?", b"#$%&*@^~+=<>", b"|/\\_[]{}`")
_STATS = len(_CLASSES) + 5  # besides: words that repeat the word before, distinct words, repeated lines; log lengths in bytes and as stated
_SIZE = WORDS + _STATS * (len(_BINS) + 2)


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i, members in enumerate(_CLASSES):
        table[list(members)] = i + 1
    return table


@dataclass
class Rows:
    """Sparse rows: row ``r`` has the features ``at[cuts[r]:cuts[r + 1]]`` with their ``values``."""

    cuts: np.ndarray
    at: np.ndarray
    values: np.ndarray


def _per_row(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the runs that ``cuts`` bound; an empty run gives zero."""
    ends = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return ends[cuts[1:]] - ends[cuts[:-1]]


def _coded(texts: pa.Array, mark: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The parts between marks as numbers of distinct parts, where each row's begin, and the distinct parts."""
    lists = pc.split_pattern(texts, mark)
    cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts, coded.dictionary


def _repeated(index: np.ndarray, cuts: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct parts once: the rows' new cuts, the parts, and how often each stands."""
    row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    pairs, counts = np.unique(row * max(1, distinct) + index, return_counts=True)
    new = np.concatenate(([0], np.cumsum(np.bincount(pairs // max(1, distinct), minlength=len(cuts) - 1)))).astype(np.int64)
    return new, pairs % max(1, distinct), counts


def features(texts: pa.Array, stated: np.ndarray) -> Rows:
    """Sparse features of texts: hashed words weighted by their share, and one bin of each statistic."""
    texts = texts.cast(pa.large_string()).fill_null("")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.concatenate(([0], np.cumsum(size)))
    raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint8)
    kinds = _class_table()[raw]
    share = np.maximum(size, 1)
    stats = [_per_row((kinds == i + 1).astype(np.int8), cuts) / share for i in range(len(_CLASSES))]
    words, word_cuts, distinct = _coded(pc.replace_substring(texts, "\n", " "), " ")
    n_words = np.diff(word_cuts)
    again = np.concatenate(([False], words[1:] == words[:-1]))[: len(words)].astype(np.int8)
    again[word_cuts[:-1][n_words > 0]] = 0
    stats.append(_per_row(again, word_cuts) / np.maximum(n_words, 1))
    own_cuts, own, counts = _repeated(words, word_cuts, len(distinct))
    stats.append(np.diff(own_cuts) / np.maximum(n_words, 1))
    lines, line_cuts, some = _coded(texts, "\n")
    stats.append(1 - np.diff(_repeated(lines, line_cuts, len(some))[0]) / np.maximum(np.diff(line_cuts), 1))
    stats.append(np.log1p(size) / 20)
    stats.append(np.log1p(np.clip(np.nan_to_num(stated, nan=0.0), 0, None)) / 20)
    hashed = np.fromiter((zlib.crc32(w.encode()) % WORDS for w in distinct.to_numpy(zero_copy_only=False)), np.int64, len(distinct))
    weight = np.sqrt(counts / np.repeat(np.maximum(n_words, 1), np.diff(own_cuts)))
    bins = np.stack([np.where(s <= 0, 0, np.searchsorted(_BINS, s) + 1) for s in stats], axis=1)
    bins += WORDS + np.arange(_STATS) * (len(_BINS) + 2)
    # Each row: its words, then its bins.
    end = own_cuts + np.arange(len(own_cuts)) * _STATS
    at, values = np.empty(end[-1], np.int64), np.ones(end[-1], np.float32)
    place = np.arange(len(own)) + np.repeat(np.arange(len(size)) * _STATS, np.diff(own_cuts))
    at[place], values[place] = hashed[own], weight
    at[(end[1:, None] - _STATS + np.arange(_STATS)).ravel()] = bins.ravel()
    return Rows(end, at, values)


def sliced(texts: pa.Array, stated: np.ndarray) -> Iterator[Rows]:
    """``features`` of runs of texts in order, so that memory follows ``SLICE`` and the longest text."""
    ends, at = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield features(texts.slice(at, to - at), stated[at:to])
        at = to


def joined(parts: list[Rows]) -> Rows:
    """The rows of all parts in order."""
    sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(p.cuts) for p in parts]])
    return Rows(np.cumsum(sizes), *[np.concatenate([getattr(p, name) for p in parts] or [np.zeros(0, kind)]) for name, kind in (("at", np.int64), ("values", np.float32))])


@dataclass
class FactorisationMachine:
    """``bias + sum w x + sum over pairs <v_i, v_j> x_i x_j``, the pairs in linear time: half of (sum v x)^2 less sum (v x)^2."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, rows: Rows) -> np.ndarray:
        vx = self.factors[rows.at] * rows.values[:, None]
        pairs = (_per_row(vx, rows.cuts) ** 2 - _per_row(vx**2, rows.cuts)).sum(axis=1) / 2
        return self.bias + _per_row(self.weights[rows.at] * rows.values, rows.cuts) + pairs

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def fit(rows: Rows, labels: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.08, ridge: float = 1e-4, seed: int = 42) -> FactorisationMachine:
    """Logistic loss by adaptive gradient steps over shuffled batches; a row's step costs time linear in its features."""
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(_SIZE, np.float32), rng.normal(0, 0.02, (_SIZE, FACTORS)).astype(np.float32))
    if not len(labels):
        return FactorisationMachine(0.0, model.weights, np.zeros_like(model.factors))
    model.bias = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    seen_w, seen_v, seen_b = np.full(_SIZE, 1e-3, np.float32), np.full((_SIZE, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            sizes = rows.cuts[own + 1] - rows.cuts[own]
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            pick = np.arange(cuts[-1]) + np.repeat(rows.cuts[own] - cuts[:-1], sizes)
            part = Rows(cuts, rows.at[pick], rows.values[pick])
            error = (model.scores(part) - labels[own]) / len(own)
            each = np.repeat(error, sizes)[:, None] * part.values[:, None]
            vx = model.factors[part.at] * part.values[:, None]
            total = np.repeat(_per_row(vx, cuts), sizes, axis=0)
            used, where = np.unique(part.at, return_inverse=True)
            sums = np.zeros((len(used), FACTORS + 1))
            for f, g in enumerate([each[:, 0], *(each * (total - vx)).T]):
                sums[:, f] = np.bincount(where, g, len(used))
            grad_w, grad_v = sums[:, 0] + ridge * model.weights[used], sums[:, 1:] + ridge * model.factors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            model.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            model.factors[used] -= rate * grad_v / np.sqrt(seen_v[used])
            seen_b += float(error.sum()) ** 2
            model.bias -= rate * float(error.sum()) / seen_b**0.5
    return model


def held_out(column: str = "doc_id"):
    """Whether a row is held out of the fit: crc32 of its key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def _read(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stated.alias("stated"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows that are not held out, and at most ``most_bytes`` of their features.

    Labels other than 0 and 1, and keys that are null or have both labels, are left out; a key that several documents share gives
    each of them its label.  Without labelled rows every score is 0.5.  Features are made in tasks, and no text reaches the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(~held_out())
    one = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality")
    rows = _read(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", "stated", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    order = [F.xxhash64("doc_id"), "doc_id", "digest", "stated"]
    first = written(_encoded(rows), "quality-sample")
    cut = first.select(*order[1:], F.length("at").alias("n")).orderBy(*order).limit(sample).toArrow()
    fits = np.cumsum(2 * cut["n"].to_numpy().astype(np.int64)) <= most_bytes  # the values are as long as the places
    table = first.orderBy(*order).limit(int(fits.sum())).select("quality", "at", "values").toArrow()
    at, values = ([np.frombuffer(x, kind) for x in table[name].to_pylist()] for name, kind in (("at", "<i4"), ("values", "<f4")))
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int64)
    flat = Rows(cuts, *[np.concatenate([np.zeros(0, kind), *parts]) for parts, kind in ((at, np.int32), (values, np.float32))])
    return fit(flat, table["quality"].to_numpy().astype(np.float64))


def _encoded(rows: DataFrame) -> DataFrame:
    """``text`` as its features: places and values, four bytes each."""
    text_batches(rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64), 0
            for found in sliced(batch.column(2).cast(pa.large_string()), sizes):
                n, ends = len(found.cuts) - 1, found.cuts.tolist()
                own = [pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()) for x in (found.at.astype("<i4"), found.values.astype("<f4"))]
                kept = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(3), kept.column(4), *own], names=["doc_id", "quality", "stated", "digest", "at", "values"])
                at += n

    return rows.mapInArrow(encode, "doc_id long, quality int, stated double, digest string, at binary, values binary")


def _scorer(docs: DataFrame, model: FactorisationMachine) -> Callable[[pa.Array, pa.Array | None], np.ndarray]:
    """Scores of texts and their stated lengths, for tasks: the model's size is fixed by its parameters (1.3 MB), so it is broadcast."""
    text_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))

    def scores(texts: pa.Array, stated: pa.Array | None) -> np.ndarray:
        own = FactorisationMachine(*shared.value)
        sizes = np.full(len(texts), np.nan) if stated is None else stated.cast(pa.float64()).to_numpy(zero_copy_only=False)
        return np.concatenate([np.zeros(0), *[own.scores(rows) for rows in sliced(texts, sizes)]])

    return scores


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """Per row ``doc_id`` and ``score``, how likely label 1 is.

    Only ``text`` and, where there is one, ``n_chars`` are inputs of a score; null and empty texts are scored as empty.
    Repeated rows each get their score; no rows give none.
    """
    scores = _scorer(docs, model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), batch.column(2)), pa.float64())], names=["doc_id", "score"])

    return _read(docs).mapInArrow(compute, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with their columns as they are; repeated rows are kept or go together."""
    scores = _scorer(docs, train(docs, labels, sample))
    text, stated = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column(text), None if stated is None else batch.column(stated))
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(choose, docs.schema)
