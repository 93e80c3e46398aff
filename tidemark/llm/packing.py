"""Best-fit packing with certified partitions.

Documents are tokenised, cut into pieces of at most `capacity` tokens and packed
into as few sequences as possible.  Pieces are dealt to groups of about a fixed
size by a hash of their row number, so that copies of one piece spread like all
others; each group is packed by best-fit decreasing.  Dual-feasible functions give a lower bound
on the sequences a group needs; a group that reaches its bound is certified and
hands over only its emptiest sequence.  A group above its bound hands over every
sequence with room left.  What was handed over is dealt to fewer, new groups and
packed again, whole sequences at a time, so that a new packing is taken only
where it needs fewer sequences.  Rounds end when one group holds all that is
left, or nothing improves.

Cases: null text is an empty document of one piece (its end id); repeated rows
are packed as often as they occur; an empty table gives no rows; lengths below
one or above the capacity are refused.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.segments import shared_encoder

#: Pieces that one task packs at a time.
GROUP_PIECES = 8192
PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_COLUMNS = f"{PIECE_COLUMNS}, sequence_id long, offset long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of n tokens: full pieces, with a shorter one first if need be."""
    full, rest = divmod(n, capacity)
    return [rest] * bool(rest) + [capacity] * full


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, lead: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every whole text, tokenised and cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(vocabulary, lead), np.array([end_id], np.uint32)
        for batch in batches:
            for at, found in encoder.batch(batch.column(1)):
                out: list[tuple] = []
                for doc, ids in zip(batch.column(0).slice(at, len(found)).to_pylist(), found, strict=True):
                    raw = memoryview(np.concatenate([ids, end]).astype("<u4").tobytes())
                    start = 0
                    for k, n in enumerate(cut_lengths(len(ids) + 1, capacity)):
                        out.append((doc, k, start, n, zlib.crc32(raw[4 * start:4 * (start + n)])))
                        start += n
                columns = list(zip(*out, strict=True))
                yield pa.record_batch({
                    "doc_id": pa.array(columns[0], pa.int64()), "piece": pa.array(columns[1], pa.int32()),
                    "start": pa.array(columns[2], pa.int64()), "length": pa.array(columns[3], pa.int64()),
                    "ids_crc32": pa.array(columns[4], pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_COLUMNS)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every length, and the number of bins.

    Bins are kept by the room they have left; a bit mask of the rooms in use
    finds the smallest that fits.
    """
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, n_bins = 0, 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = in_use >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                in_use &= ~(1 << room)
        else:
            room, own, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = own, capacity - room
        if room > size:
            by_room[room - size].append(own)
            in_use |= 1 << (room - size)
    return bins, offsets, n_bins


def lower_bound(histogram: np.ndarray, capacity: int, steps: int = 8) -> int:
    """Bins that any packing of histogram[length] pieces needs at least.

    Dual-feasible functions of two families and their compositions: one rounds
    lengths above capacity - e up to a whole bin and drops those below e, the
    other rounds (k + 1) x length / capacity down to steps of 1 / k.
    """
    if not histogram.sum():
        return 0
    length = np.arange(capacity + 1)
    cuts = np.arange(0, capacity // 2 + 1)[:, None]
    first = np.where(length > capacity - cuts, capacity, np.where(length < cuts, 0, length))
    best = int(-(-(first @ histogram).max() // capacity))
    for k in range(1, steps + 1):
        scaled = (k + 1) * first
        second = np.where(scaled % capacity == 0, first * k, scaled // capacity * capacity)
        best = max(best, int(-(-(second @ histogram).max() // (capacity * k))))
    return best


def _packed_group(rows: pa.Table, capacity: int, first_id: int, step: int) -> pa.Table:
    """One group packed; handed_over marks the sequences that go to the next round."""
    order = ["doc_id", "piece", "ids_crc32", "start", "sequence_id", "offset"]
    rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in order)])
    lengths = rows["length"].to_numpy()
    bins, offsets, n_bins = best_fit_decreasing(lengths, capacity)
    first_time = rows["sequence_id"].null_count > 0
    old = np.zeros(0, np.int64) if first_time else np.unique(rows["sequence_id"].to_numpy())
    if first_time or n_bins < len(old):
        ids = first_id + step * bins
        rows = (rows.drop_columns(["sequence_id", "offset"])
                .append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)))
    else:
        ids, n_bins = rows["sequence_id"].to_numpy(), len(old)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    _, place = np.unique(ids, return_inverse=True)
    filled = np.bincount(place, weights=lengths).astype(np.int64)
    room = filled < capacity
    if n_bins <= bound:
        room &= np.arange(len(filled)) == filled.argmin()
    return rows.append_column("handed_over", pa.array(room[place]))


def _packer(capacity: int, first_id: int, groups: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Sequence numbers count on from first_id, the groups taking turns: no group's size bounds them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _packed_group(rows.drop_columns(["own_group"]), capacity, first_id + key[0].as_py(), groups)

    return run


def dealt(rows: DataFrame, unit: Column, groups: int, round_no: int = 0) -> DataFrame:
    """Rows with the group of their unit: a row number in the first round, a sequence later on."""
    return rows.withColumn("own_group", F.pmod(F.xxhash64(unit, F.lit(round_no)), F.lit(groups)))


def pack(items: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows of pieces() with sequence_id and offset.  items is read twice: pass a written table."""
    unit = F.monotonically_increasing_id()  # later rounds move whole sequences
    open_rows = items.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    done: DataFrame | None = None
    first_id, round_no, sequences = 0, 0, None
    while True:
        n = open_rows.count()
        groups = max(1, -(-n // group_pieces))
        result = written(
            dealt(open_rows, unit, groups, round_no).groupBy("own_group")
            .applyInArrow(_packer(capacity, first_id, groups), f"{PACKED_COLUMNS}, handed_over boolean"), "packed")
        now, highest = result.agg(F.count_distinct(F.when(F.col("handed_over"), F.col("sequence_id"))),
                                  F.max("sequence_id")).first()
        if groups == 1 or not now or now == sequences:
            rest = result.drop("handed_over")
            return rest if done is None else done.unionByName(rest)
        kept = result.where("not handed_over").drop("handed_over")
        done = kept if done is None else done.unionByName(kept)
        open_rows = result.where("handed_over").drop("handed_over")
        unit, sequences = F.col("sequence_id"), now
        first_id, round_no = max(first_id, highest + 1), round_no + 1


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """Sequences used, and the lower bound for all pieces together (from at most `capacity` counts)."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    return packed.select(F.count_distinct("sequence_id")).first()[0], lower_bound(counts, capacity)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(written(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
