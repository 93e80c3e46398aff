import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing as P

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_and_bound(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, n = P.best_fit_decreasing(lengths, 100)
    for b in range(n):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()][:len(own)]
        assert lengths[own].sum() <= 100
    bound = P.lower_bound(np.bincount(lengths, minlength=101), 100)
    assert -(-int(lengths.sum()) // 100) <= bound <= n


def fewest(lengths, capacity):
    """The least number of bins, by trying every place for every length."""
    best = [len(lengths)]

    def put(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(rooms)
            return
        for i in {room: i for i, room in enumerate(rooms) if room >= lengths[at]}.values():
            put(at + 1, [*rooms[:i], rooms[i] - lengths[at], *rooms[i + 1:]])
        put(at + 1, [*rooms, capacity - lengths[at]])

    put(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_against_the_optimum(lengths):
    """The bound never exceeds the fewest bins there can be, best fit stays near them."""
    sizes = np.array(sorted(lengths, reverse=True), np.int64)
    least = fewest(sizes.tolist(), 20)
    assert P.lower_bound(np.bincount(sizes, minlength=21), 20) <= least
    assert P.best_fit_decreasing(sizes, 20)[2] <= (11 * least + 6) / 9


def test_bound_beats_the_sum():
    assert P.lower_bound(np.bincount([51] * 10, minlength=101), 100) == 10
    assert P.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5


def test_lengths_out_of_range():
    for bad in (0, 101):
        with pytest.raises(ValueError):
            P.best_fit_decreasing(np.array([bad]), 100)


def checked(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_edges(spark, edge_docs, no_docs):
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    got = P.pack_documents(edge_docs, BYTES, 2, 64).collect()
    checked(got, 64)
    want = []
    for d in edge_docs.collect():
        ids = np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        start = 0
        for k, n in enumerate(P.cut_lengths(len(ids), 64)):
            want.append((d.doc_id or -1, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
            start += n
    key = lambda r: (r[0] or -1, *r[1:5])
    assert sorted(key(tuple(r)) for r in got) == sorted((a or -1, *rest) for a, *rest in want)
    assert P.pack_documents(no_docs, BYTES, 2, 64).count() == 0


def test_exchange_saves_sequences(spark):
    items = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        (F.pmod(F.xxhash64("id"), F.lit(97)) + 3).alias("length"), F.col("id").alias("ids_crc32")).persist()
    small = P.pack(items, 400, group_pieces=60)
    n = checked(small.collect(), 400)
    used, bound = P.certificate(small, 400)
    assert small.count() == 3000 and used == n
    assert n <= 1.005 * bound + 1
    again = {tuple(r) for r in P.pack(items, 400, group_pieces=60).collect()}
    assert again == {tuple(r) for r in small.collect()}


def test_copies_spread_over_groups(spark):
    """A third of all pieces alike: groups stay near their size, sequences apart."""
    items = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(0).alias("piece"),
        F.lit(0).cast("long").alias("start"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"),
        F.lit(1).cast("long").alias("ids_crc32")).persist()
    sizes = P.dealt(items, F.monotonically_increasing_id(), 30).groupBy("own_group").count().collect()
    assert len(sizes) == 30 and max(r["count"] for r in sizes) < 2000
    packed = P.pack(items, 100, group_pieces=1000)
    assert packed.count() == 30_000
    n = checked(packed.collect(), 100)
    assert n <= 1.01 * P.certificate(packed, 100)[1] + 1


def test_sequence_numbers_of_large_groups():
    """Numbers of different groups differ whatever their sizes; later rounds count on from there."""
    rows = {"doc_id": range(9), "piece": [0] * 9, "start": [0] * 9, "length": [3] * 9, "ids_crc32": range(9),
            "sequence_id": [None] * 9, "offset": [None] * 9, "own_group": [0] * 9}
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in rows.items()})
    seen = [set(P._packer(3, 100, 4)((pa.scalar(g),), table)["sequence_id"].to_pylist()) for g in range(4)]
    assert all(len(s) == 9 for s in seen) and len(set.union(*seen)) == 36 and min(map(min, seen)) == 100
