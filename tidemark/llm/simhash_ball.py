"""Near-duplicate texts by SimHash, found by meet-in-the-middle ball hashing.

Fingerprints within distance 3 are linked.  Every distinct fingerprint emits all
variants within half the radius, one bit; equal variants meet in a shuffle.  The
radius is odd, so one bit from either side covers two of the three differing
bits.  The third is taken by a hole: the variants are formed four times, each
time without one quarter of the 64 bits.  Some quarter holds a differing bit, so
for it at most two differ in the 48 bits kept, and the variant between them is
emitted by both.  That is 4 x 49 = 196 variants a fingerprint instead of the
2081 within two bits, and no link is lost.

Colliding fingerprints are verified on all 64 bits.  Two in a bucket are compared
directly.  In longer buckets the pairs are not enumerated: rows that agree in the
hole differ by two bits at most and form a chain; across holes, rows are looked
up at every hole value at distance 1, and, from rows that are the variant itself,
at distance 2 and 3.  This takes a fixed number of look-ups a row and gives the
same components as all pairs would.

Components are found by alternating large and small stars on distinct
fingerprints, so exact copies never enlarge the graph.

Cases: null or wordless text has fingerprint zero and links like any other; texts
with fewer words than a shingle hash their whole sequence; copies, repeated rows
and null ids get their group's component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import raw_texts, written

SHINGLE_WORDS = 3
RADIUS = 3
HASH_SEED = 42
_HOLES, _HOLE_BITS = 4, 16
_KEPT_BITS = 64 - _HOLE_BITS
_CHUNK = 1 << 16
#: Fingerprints whose variants one task makes.
EMIT_ROWS = 16_384


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    tokens = text.lower().split()  # bytes: A-Z only, and white space is 09-0D and 20
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[min(words, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, np.int64), len(last)
    for at in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[a:b], HASH_SEED)
                           for a, b in zip(starts[at:at + _CHUNK], last[at:at + _CHUNK], strict=False)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64) if len(bits) > 255 else bits.sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, row: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text, and the long column `row` if one is named."""
    carried = [row] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, words) for t in raw_texts(batch.column(1))], np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(values.view(np.int64)),
                                   **{name: batch.column(2) for name in carried}})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried)
            .mapInArrow(run, ", ".join(["doc_id long", "fp long", *[f"{name} long" for name in carried]])))


def _kept(fps: np.ndarray, hole: int) -> np.ndarray:
    """The 48 bits outside the hole, side by side."""
    low = np.uint64(hole * _HOLE_BITS)
    below = fps & ((np.uint64(1) << low) - np.uint64(1))
    return (fps >> low >> np.uint64(_HOLE_BITS) << low) | below


def _in_hole(fps: np.ndarray, hole: np.ndarray) -> np.ndarray:
    return fps >> (hole * np.uint64(_HOLE_BITS)) & np.uint64((1 << _HOLE_BITS) - 1)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], 1 << np.arange(_KEPT_BITS)]).astype(np.uint64)
    for batch in batches:
        all_fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(all_fps), 4096):
            fps = all_fps[at:at + 4096]
            keys = np.concatenate([((_kept(fps, h)[:, None] ^ flips) | np.uint64(h << _KEPT_BITS)).ravel()
                                   for h in range(_HOLES)])
            own = np.tile(np.repeat(fps, len(flips)), _HOLES)
            yield pa.record_batch({"variant": pa.array(keys.view(np.int64)), "fp": pa.array(own.view(np.int64))})


def _hole_flips(bits: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(_HOLE_BITS), bits)], np.uint64)


def _bucket_links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of linked fingerprints that connect whatever any pair in a bucket would.

    Rows are sorted by (key, fp); buckets are whole.
    """
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(keys)))
    pairs = start[size == 2]
    a, b = fps[pairs], fps[pairs + 1]
    near = np.bitwise_count(a ^ b) <= RADIUS
    yield a[near], b[near]

    many = np.repeat(size > 2, size)
    keys, fps = keys[many], fps[many]
    if not len(keys):
        return
    bucket = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])).astype(np.uint64)
    hole = keys >> np.uint64(_KEPT_BITS)
    place = bucket << np.uint64(_HOLE_BITS) | _in_hole(fps, hole)
    order = np.argsort(place, kind="stable")
    keys, fps, hole, place = keys[order], fps[order], hole[order], place[order]
    same = place[1:] == place[:-1]
    yield fps[:-1][same], fps[1:][same]

    kept = np.zeros_like(fps)
    for h in range(_HOLES):
        own = hole == h
        kept[own] = _kept(fps[own], h)
    centre = kept == keys & np.uint64((1 << _KEPT_BITS) - 1)

    def looked_up(rows: np.ndarray, among: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """rows x the first of `among` at each hole value at distance `bits`."""
        places = place[among]
        left, right = [], []
        for flip in _hole_flips(bits):
            sought = place[rows] ^ flip
            at = np.minimum(np.searchsorted(places, sought), len(places) - 1)
            hit = places[at] == sought
            left.append(fps[rows[hit]])
            right.append(fps[among[at[hit]]])
        return np.concatenate(left), np.concatenate(right)

    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    centres = np.flatnonzero(centre)
    several = np.bincount(bucket[order][heads].astype(np.int64))  # hole values by bucket
    heads_of = lambda rows: rows[several[bucket[order][rows].astype(np.int64)] > 1]
    yield looked_up(heads_of(heads), heads, 1)
    if len(centres):
        yield looked_up(heads_of(centres), heads, 2)
        yield looked_up(heads_of(centres), centres, 3)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by (variant, fp); a bucket that reaches over a batch is held back."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def linked(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(k) > 1:
            for a, b in _bucket_links(k.view(np.uint64), f.view(np.uint64)):
                if len(a):
                    ends = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=0)
                    ends = ends[ends[:, 0] != ends[:, 1]]
                    yield pa.record_batch({"a": pa.array(ends.min(axis=1)), "b": pa.array(ends.max(axis=1))})

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy()])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield from linked(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    yield from linked(keys, fps)


def links(distinct: DataFrame) -> DataFrame:
    """a < b: linked fingerprints that span the components of all links within RADIUS bits.

    distinct is a written table.  Fingerprints are few bytes and make many
    variants, so they are dealt by their number, not by their size.
    """
    tasks = max(1, -(-distinct.count() // EMIT_ROWS))
    return (distinct.select("fp").repartition(tasks, "fp").mapInArrow(_emit, "variant long, fp long")
            .repartition("variant").sortWithinPartitions("variant", "fp")
            .mapInArrow(_link, "a long, b long").distinct())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: edges (a > b) re-hung on each node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written, so that the join below reads both sides from plain shuffles: those of a hub can be split
    smallest = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    hung = both.join(smallest, "u")
    if large:
        return hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    return (hung.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the links can reach."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b").distinct(), "links")
    mark = lambda df: tuple(df.select(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                                      F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while True:
        edges = written(_stars(_stars(edges, large=True), large=False), "stars")
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _rooted(prints: DataFrame, first: Column) -> DataFrame:
    """fp, first (the smallest `first` of its rows) and root (its component) of every distinct fingerprint."""
    distinct = written(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    return written(distinct.join(components(links(distinct)).withColumnRenamed("node", "fp"), "fp", "left")
                   .withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    rooted = _rooted(prints, F.col("doc_id"))
    smallest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "classes")
    classes = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, row: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """`row` (a number that tells rows apart) of one row a component: smallest doc_id, null last, then smallest row."""
    prints = written(fingerprints(docs, words, row), "fingerprints")
    rooted = _rooted(prints, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col(f"first.{row}").alias(row))
