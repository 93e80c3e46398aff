"""Token ids on disk as patched frame-of-reference blocks.

A file holds the ids of consecutive documents.  Ids are cut into blocks of 128.
Each block stores its minimum, packs the differences to it at the width that
covers a percentile of them (of the given ones, that which makes the block
smallest), and keeps the high bits of the few wider ones in an exception list.  The file starts with an index of its block starts, so one
document can be read without unpacking the rest.

Layout, little-endian:
    magic "PFB1", u32 documents, u64 ids, u32 blocks
    i64 document id, u8 "id is null", u64 end (ids up to and with it) per document
    u64 start of each block, counted from the first block, and one for the end
    block: u32 minimum, u8 width, u8 exceptions n,
           16 x width bytes of packed low bits (value i at bits i x width ..),
           n places (u8), n high parts (u32: difference >> width)

Files are rows (file_no, part_no, documents, ids, payload) written by Spark: its
committer leaves whole files only, whatever executors are lost, and any store
that Spark reaches will do.  A file is one or more parts of about PART_IDS ids.

Cases: null text counts as empty; a null document id sorts first; equal document
ids stay separate documents, in the order they are read; an empty table gives no files.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_path
from tidemark.llm.segments import shared_encoder

BLOCK = 128
#: A block is packed at the width that covers one of these shares of its values, whichever makes it smallest.
PERCENTILES = (0.8, 0.9, 0.95, 1.0)
PART_IDS = 1 << 20
#: n documents make sqrt(n) / FILES_PER_ROOT files: few short ones, and not millions of them when n is billions.
FILES_PER_ROOT = 16
_HEAD = struct.Struct("<4sIQI")
_MAGIC = b"PFB1"
_BLOCK_HEAD = 6


_SHORT_WIDTHS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def _widths(differences: np.ndarray) -> np.ndarray:
    """Bits of every value."""
    if differences.max() < 1 << 16:
        return _SHORT_WIDTHS[differences]
    return np.frexp(differences.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentiles: tuple[float, ...] = PERCENTILES) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks (with the end) and their bytes.  The last block is padded with its last id."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, "<u8"), b""
    padded = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.uint32).reshape(n, BLOCK)
    lowest = padded.min(axis=1)
    diff = padded - lowest[:, None]
    bits = _widths(diff)
    ranks = [max(0, int(np.ceil(p * BLOCK)) - 1) for p in percentiles]
    choices = np.partition(bits, ranks, axis=1)[:, ranks]
    outside = np.stack([(bits > choices[:, k, None]).sum(axis=1) for k in range(len(ranks))], axis=1)
    cost = choices.astype(np.int64) * (BLOCK // 8) + 5 * outside
    best = cost.argmin(axis=1)
    width = choices[np.arange(n), best]
    wide = bits > width[:, None]
    exceptions = wide.sum(axis=1)
    sizes = _BLOCK_HEAD + cost[np.arange(n), best]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = lowest.astype("<u4").view(np.uint8).reshape(n, 4)
    out[at + 4] = width
    out[at + 5] = exceptions
    for w in np.unique(width):
        if not w:
            continue
        own = np.flatnonzero(width == w)
        packed = _pack(diff[own], int(w))
        out[(at[own] + _BLOCK_HEAD)[:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(wide)
    first = np.concatenate([[0], np.cumsum(exceptions)])[:-1]
    turn = np.arange(len(block)) - first[block]
    tail = at[block] + _BLOCK_HEAD + width[block].astype(np.int64) * (BLOCK // 8)
    out[tail + turn] = place
    high = (diff[block, place] >> width[block]).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail + exceptions[block] + 4 * turn)[:, None] + np.arange(4)] = high
    return starts.astype("<u8"), out.tobytes()


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    kind = "<u2" if width <= 16 else "<u4"
    low = (values & np.uint32((1 << width) - 1)).astype(kind)
    bits = np.unpackbits(low.view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    kept = bits.reshape(len(values), BLOCK, -1)[:, :, :width].reshape(len(values), -1)
    return np.packbits(kept, axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    size = 16 if width <= 16 else 32
    bits = np.zeros((len(packed), BLOCK, size), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    raw = np.packbits(bits.reshape(len(packed), -1), axis=1, bitorder="little")
    return raw.view("<u2" if size == 16 else "<u4").astype(np.uint32)


def unpack_blocks(starts: np.ndarray, data: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks whose starts are given, the first n_ids of them."""
    n = len(starts) - 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    at = (starts[:-1] - starts[0]).astype(np.int64)
    lowest = data[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, exceptions = data[at + 4], data[at + 5].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            diff[own] = _unpack(data[(at[own] + _BLOCK_HEAD)[:, None] + np.arange(int(w) * BLOCK // 8)], int(w))
    block = np.repeat(np.arange(n), exceptions)
    turn = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = at[block] + _BLOCK_HEAD + width[block].astype(np.int64) * (BLOCK // 8)
    place = data[tail + turn]
    high = data[(tail + exceptions[block] + 4 * turn)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    diff[block, place] |= high << width[block].astype(np.uint32)
    return (diff + lowest[:, None]).ravel()[:n_ids]


def to_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file part from its documents' ids."""
    ends = np.cumsum([len(x) for x in ids], dtype="<u8")
    all_ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts, packed = pack_blocks(all_ids)
    return b"".join([
        _HEAD.pack(_MAGIC, len(ids), len(all_ids), len(starts) - 1),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids),
        ends.tobytes(), starts.tobytes(), packed])


class Part:
    """A file part opened for reading."""

    def __init__(self, payload: bytes) -> None:
        magic, docs, self.n_ids, n_blocks = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a file of token blocks")
        at = _HEAD.size
        known = np.frombuffer(payload, "<i8", docs, at)
        null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(known, null, strict=True)]
        self.ends = np.frombuffer(payload, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.block_starts = np.frombuffer(payload, "<u8", n_blocks + 1, at + 17 * docs)
        self._data = np.frombuffer(payload, np.uint8, offset=at + 17 * docs + 8 * (n_blocks + 1))

    def ids(self) -> np.ndarray:
        return unpack_blocks(self.block_starts, self._data, self.n_ids)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by the index: only its own blocks are read."""
        start, end = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        first, last = start // BLOCK, -(-end // BLOCK)
        index = self.block_starts[first:last + 1].astype(np.int64)
        if start == end:
            return np.zeros(0, np.uint32)
        got = unpack_blocks(index, self._data[index[0]:index[-1]], min(self.n_ids, last * BLOCK) - first * BLOCK)
        return got[start - first * BLOCK:end - first * BLOCK]


def _parts(vocabulary: str, end_id: int, lead: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """file_no, doc_id, text of one file in order to its parts, encoded as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(vocabulary, lead), np.array([end_id], np.uint32)
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        file_no, part_no, size = 0, 0, 0

        def closed() -> pa.RecordBatch:
            return pa.record_batch({
                "file_no": pa.array([file_no], pa.int32()), "part_no": pa.array([part_no], pa.int32()),
                "documents": pa.array([len(docs)], pa.int64()), "ids": pa.array([size], pa.int64()),
                "payload": pa.array([to_bytes(docs, ids)], pa.large_binary()).cast(pa.binary())})

        for batch in batches:
            if len(batch):
                file_no = batch.column(0)[0].as_py()
            for at, found in encoder.batch(batch.column(2)):
                for doc, own in zip(batch.column(1).slice(at, len(found)).to_pylist(), found, strict=True):
                    docs.append(doc)
                    ids.append(np.concatenate([own, end]))
                    size += len(own) + 1
                    if size >= PART_IDS:
                        yield closed()
                        docs, ids, part_no, size = [], [], part_no + 1, 0
        if docs:
            yield closed()

    return run


def files_for(n: int) -> int:
    """Files for n documents: their number and their length both grow with its root."""
    return max(1, math.ceil(math.sqrt(n) / FILES_PER_ROOT))


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, lead: bool, files: int | None = None) -> None:
    """Encode doc_id, text and write the files below path, ids in ascending doc_id order.

    docs is a table or a written frame: rows are numbered as they are read, so that
    documents with one id are cut into files like all others.  A file is one range
    of (doc_id, row number), encoded by the task that writes it.
    """
    n = files or files_for(docs.count())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    (rows.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
     .select(F.spark_partition_id().alias("file_no"), "doc_id", "text")
     .mapInArrow(_parts(vocabulary, end_id, lead), "file_no int, part_no int, documents long, ids long, payload binary")
     .write.option("compression", "none").parquet(path))


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    per_file = files.groupBy("file_no").agg(F.sum("ids").alias("file_ids"))
    before_file = per_file.select("file_no", (F.sum("file_ids").over(Window.orderBy("file_no"))
                                              - F.col("file_ids")).alias("before_file"))
    own = Window.partitionBy("file_no").orderBy("part_no")
    offsets = (files.select("file_no", "part_no", "ids",
                            (F.sum("ids").over(own) - F.col("ids")).alias("before_part"))
               .join(before_file, "file_no")
               .select("file_no", "part_no", (F.col("before_file") + F.col("before_part")).alias("before")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, part_no, payload in zip(*batch.columns, strict=True):
                part = Part(payload.as_py())
                raw = memoryview(part.ids().astype("<u4").tobytes())
                starts = np.concatenate([[0], part.ends[:-1]])
                docs = len(part.doc_ids)
                yield pa.record_batch({
                    "file_no": pa.array([file_no.as_py()] * docs, pa.int32()),
                    "part_no": pa.array([part_no.as_py()] * docs, pa.int32()),
                    "doc_id": pa.array(part.doc_ids, pa.int64()), "within": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(part.ends - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in
                                           zip(starts.tolist(), part.ends.tolist(), strict=True)], pa.int64())})

    found = files.select("file_no", "part_no", "payload").mapInArrow(
        run, "file_no int, part_no int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["file_no", "part_no"]).select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(docs: DataFrame, vocabulary: str, end_id: int, lead: bool = False,
                     files: int | None = None) -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_files(docs, path, vocabulary, end_id, lead, files)
    return read_files(spark.read.parquet(path))
