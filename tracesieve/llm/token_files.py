"""Token-id files: ids ranked by frequency, one to four bytes each, with the byte counts in a stream of control bytes.

A folder holds files of consecutive documents in ascending ``doc_id`` order and an ``index`` table of where each file begins.
A file can be decoded alone.  Little-endian layout:
``TSV1`` | documents u32 | table size u32 | token ids by rank u32[table size] |
per document: ``doc_id`` i64, null flag u8, ids u32 | control bytes, four ids each | data bytes.
A control byte has two bits for each of four ids, lowest first: the id's bytes less one.  The table has the ids that the file
uses, most frequent in the whole corpus first.  Data are decoded by looking each control byte up in a table of shuffles.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracesieve.llm.batches import text_batches
from tracesieve.llm.tokens import SLICE, encoder, vocabulary_path
from tracesieve.session import ship, work_path, written

END_ID = 1
#: Ids that a file holds, about.
FILE_IDS = 4 << 20
#: The most partitions of one run, which bounds what the driver keeps of them: a count for each.
MOST_PARTITIONS = 1 << 16
MAGIC = b"TSV1"

_KEY = [("doc_id", "<i8"), ("null", "u1"), ("ids", "<u4")]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: where in its data the 16 bytes of four ids are (or past the end: zero), and the data's size."""
    widths = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4 + 1
    starts = np.cumsum(widths, axis=1) - widths
    byte = np.arange(4)
    places = np.where(byte < widths[:, :, None], starts[:, :, None] + byte, 16)
    return places.reshape(256, 16), widths.sum(axis=1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """The control bytes and the data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    padded = np.concatenate((ranks, np.zeros(-len(ranks) % 4, "<u4")))
    extra = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (extra.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    kept = np.arange(4) <= extra[:, None]
    kept[len(ranks) :] = False
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ranks, by table lookup for each control byte; bounded runs keep the memory even."""
    places, sizes = _tables()
    held = (places < 16).astype(np.uint8)
    codes = np.frombuffer(control, np.uint8)
    ends = np.cumsum(sizes[codes])
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(32, np.uint8)))
    out = np.empty((len(codes), 4), "<u4")
    for a in range(0, len(codes), 1 << 16):
        part = codes[a : a + (1 << 16)]
        starts = ends[a : a + len(part)] - sizes[part]
        place = places[part]
        found = raw[starts[:, None] + place]
        found *= held[part]
        out[a : a + len(part)] = found.view("<u4")
    return out.reshape(-1)[:count]


def write_block(keys: np.ndarray, ids: np.ndarray, rank: np.ndarray) -> bytes:
    """The bytes of one file: its documents ``keys``, all their ``ids``, the corpus rank of each id."""
    ranks = rank[ids]
    used = np.flatnonzero(np.bincount(ranks, minlength=len(rank)))
    by_rank, local = np.zeros(len(rank), "<u4"), np.zeros(len(rank), "<u4")
    by_rank[rank] = np.arange(len(rank), dtype="<u4")
    local[used] = np.arange(len(used), dtype="<u4")  # the order is kept: frequent ids stay small
    control, data = encode_ranks(local[ranks])
    return b"".join((MAGIC, struct.pack("<II", len(keys), len(used)), by_rank[used].tobytes(), keys.tobytes(), control, data))


def read_block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a file and all their ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token-id file")
    documents, size = struct.unpack_from("<II", raw, 4)
    table = np.frombuffer(raw, "<u4", size, 12)
    at = 12 + 4 * size
    keys = np.frombuffer(raw, _KEY, documents, at)
    at += keys.nbytes
    count = int(keys["ids"].sum(dtype=np.int64))
    groups = -(-count // 4)
    return keys, table[decode_ranks(raw[at : at + groups], raw[at + groups :], count)]


def token_table(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``ids`` (end id included), their count and their crc32 as 32-bit integers; one row per input row.

    The ids are little-endian and unsigned, of as many bits as ``width`` says.
    """
    text_batches(docs, SLICE)
    path = vocabulary_path(vocabulary)
    kind = width(path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            row = 0
            for ids, counts in tool.encode(batch.column(1)):
                whole = np.insert(ids, np.cumsum(counts), end)
                ends = np.cumsum(counts + 1).tolist()
                parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
                crc = pa.array([zlib.crc32(x) for x in parts], pa.int64())
                found = [x.tobytes() for x in np.split(whole.astype(kind), ends[:-1])]
                columns = [batch.column(0).slice(row, len(found)), pa.array(found, pa.binary()), pa.array(counts + 1, pa.int64()), crc]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "crc"])
                row += len(found)

    schema = "doc_id long, ids binary, n_tokens long, crc long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)


def width(path: str, end_id: int) -> str:
    """The least of 16 and 32 bits that holds every id of the vocabulary, as a numpy type."""
    return "<u2" if max(encoder(path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def frequency_ranks(table: DataFrame, kind: str) -> np.ndarray:
    """The rank of each token id by its count over all documents, ties to the smaller id.

    Tasks send back one count for each id that they saw; ids are at most the vocabulary's, which bounds the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(own) > len(total):
                total = np.concatenate((total, np.zeros(len(own) - len(total), np.int64)))
            total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    found = table.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    rank = np.zeros(int(found["id"].max()) + 1 if len(found) else 0, np.int64)
    counts = rank.copy()
    counts[found["id"]] = found["n"]
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(rank))
    return rank


def write_token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> str:
    """Write the documents' ids as token-id files into the folder ``path`` and return it.

    Null ``doc_id`` come first; rows that share a ``doc_id`` follow each other, ordered by their ids; a null text is its end id.
    No documents give an index without files.  Other columns are not read.  A file is written under a name of the attempt's own
    and then renamed, and holds the same bytes whoever writes it, so a lost or repeated task does no harm.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "token-files")
    table = written(token_table(docs, vocabulary, end_id), "token-ids", compression="zstd")
    kind = width(vocabulary_path(vocabulary), end_id)
    rank = spark.sparkContext.broadcast(frequency_ranks(table, kind))
    total = table.agg(F.sum("n_tokens")).head()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, ids, held = TaskContext.get().partitionId(), [], 0, []

        def flush() -> None:
            rows = pa.Table.from_batches(held)
            keys = np.zeros(len(rows), _KEY)
            keys["null"] = rows["doc_id"].is_null().to_numpy()
            keys["doc_id"] = rows["doc_id"].fill_null(0).to_numpy()
            keys["ids"] = rows["n_tokens"].to_numpy()
            own = np.frombuffer(b"".join(rows["ids"].to_pylist()), kind)
            name = f"ids-{part:06d}-{len(files):06d}.tsv"
            _put(path, name, write_block(keys, own, rank.value))
            files.append((name, part, len(files), len(own)))

        for batch in batches:
            ends = np.cumsum(batch.column(2).to_numpy())
            at = 0
            while at < len(ends):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + FILE_IDS - ids, side="right")))
                held.append(batch.slice(at, to - at))
                ids, at = ids + int(ends[to - 1]) - done, to
                if ids >= FILE_IDS or at < len(ends):
                    flush()
                    ids = held.clear() or 0
        if held:
            flush()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "part", "n", "n_tokens"), x)) for x in files], pa.schema(_INDEX))

    parts = min(MOST_PARTITIONS, max(1, -(-total // FILE_IDS)))
    ordered = table.repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "ids").select("doc_id", "ids", "n_tokens")
    made = written(ordered.mapInArrow(write, "file string, part long, n long, n_tokens long"), "token-index")
    sizes, before, at = made.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), [], 0
    for r in sorted(sizes):
        before.append((r["part"], at))
        at += r["n"]
    offsets = spark.createDataFrame(before, "part long, before long")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("n")) - F.col("n_tokens")
    index = made.withColumn("inside", inside).join(F.broadcast(offsets), "part").select("file", (F.col("before") + F.col("inside")).alias("first"), "n_tokens")
    index.write.mode("overwrite").parquet(f"{path}/index")
    rank.unpersist()
    return path


_INDEX = [("file", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("n_tokens", pa.int64())]


def _put(folder: str, name: str, raw: bytes) -> None:
    from pyarrow import fs

    files, where = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{os.path.abspath(folder)}")
    files.create_dir(where, recursive=True)
    own = f"{where}/_{name}.{os.getpid()}-{os.urandom(6).hex()}"
    with files.open_output_stream(own) as out:
        out.write(raw)
    files.move(own, f"{where}/{name}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                keys, ids = read_block(content.as_py())
                counts = keys["ids"].astype(np.int64)
                ends = np.cumsum(counts)
                ids = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array([name.as_py()] * len(keys)), pa.array(keys["doc_id"], pa.int64(), mask=keys["null"].astype(bool)), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "file string, doc_id long, start long, n_tokens long, ids_crc32 long"
    content = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.tsv").load(path)
    found = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(read, schema)
    index = spark.read.schema("file string, first long, n_tokens long").parquet(f"{path}/index").select("file", "first")
    return found.join(index, "file").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
