"""Packing documents into token windows by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracesieve.llm.batches import text_batches
from tracesieve.llm.tokens import SMALL_MEMORY, encoder, vocabulary_path
from tracesieve.session import written

WINDOW = 4096
END_ID = 2
#: Pieces packed together.  Every piece is packed; more pieces make more groups of about this size.
GROUP = 16_384

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree whose leaf ``c`` counts those with ``c`` places left."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node, count = capacity + self.size, self.count
        while node:
            count[node] += by
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity that still holds ``length``; ties: the latest opened."""
        node, count = length + self.size, self.count
        if not count[node]:
            # Up until a right neighbour has a window, then down to its leftmost leaf.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._change(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece, longest pieces first, each into the tightest window that holds it."""
    names, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        capacity, name = free.tightest(length) or (window, opened)
        opened += name == opened
        names[i], offsets[i] = name, window - capacity
        if capacity > length:
            free.add(capacity - length, name)
    return names, offsets


def pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``window`` ids: overlong documents are cut into full windows and a rest.

    A null or empty text is its end id alone.  Only ``doc_id`` and ``text`` are read; a repeated row is a document
    of its own and a null ``doc_id`` stays null.  ``keep_ids`` adds the ids as ``ids`` (little-endian unsigned 32-bit).
    """
    text_batches(docs)
    path = vocabulary_path(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(path, SMALL_MEMORY), np.array([end_id], dtype="<u4")
        for batch in batches:
            keys, row = batch.column(0), 0
            for ids, counts in tool.encode(batch.column(1)):
                at, of, start, length, crc, total, kept = 0, [], [], [], [], [], []
                for n in counts.tolist():
                    own = np.concatenate((ids[at : at + n], end))
                    for s in range(0, n + 1, window):
                        raw = own[s : s + window].tobytes()
                        of.append(row)
                        start.append(s)
                        length.append(len(raw) // 4)
                        crc.append(zlib.crc32(raw))
                        total.append(n + 1)
                        if keep_ids:
                            kept.append(raw)
                    at, row = at + n, row + 1
                columns = [keys.take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names=names)

    schema = _PIECES + ", ids binary" * keep_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Where every token piece goes: ``sequence_id`` and ``offset`` beside the columns of ``pieces``.

    Pieces are dealt by a hash into groups of about ``GROUP``, and each group is packed on its own, so no task sees more
    however many there are and a repeated or long document is spread.  No documents give no rows.
    A sequence holds at most ``window`` ids, its pieces stand without gaps from 0, and each id is in exactly one piece.
    """
    cut = written(pieces(docs, vocabulary, window, end_id, keep_ids).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-cut.count() // GROUP))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("_piece")
        names, offsets = best_fit(table["length"].to_numpy(), window)
        first = table["_group"][0].as_py() << 32
        return table.drop_columns(["_piece", "_group"]).append_column("sequence_id", pa.array(names + first)).append_column("offset", pa.array(offsets))

    schema = _PIECES + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_piece"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(fit, schema)


def sequences(layout: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences of a layout made with ``keep_ids``: ``sequence_id``, ``length`` and ``ids`` with their padding.

    A sequence is padded to ``window`` unless its length is a power of two already.
    """
    size = F.length("ids") / 4
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = layout.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(transform(parts, p -> hex(p.ids)), '', (a, x) -> concat(a, x))").alias("text"))
    whole = joined.select("sequence_id", F.unhex("text").alias("ids")).withColumn("length", size.cast("long"))
    full = F.expr("bit_count(length) = 1")
    blank = F.lit(int(pad_id).to_bytes(4, "little").hex())
    padded = F.unhex(F.concat(F.hex("ids"), F.when(full, "").otherwise(F.repeat(blank, (F.lit(window) - F.col("length")).cast("int")))))
    return whole.select("sequence_id", "length", padded.alias("ids"))
