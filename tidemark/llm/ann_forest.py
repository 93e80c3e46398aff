"""Nearest neighbours by a forest of hash prefixes.

Every tree hashes a vector to a long string of DEPTH one-bit characters: on which
side of a random plane through the origin it lies.  Near vectors agree on more of
them.  A tree is the array of its strings, sorted.  A query descends in every tree
to the vectors that share the longest prefix with it, however long that is, and
then ascends in all trees in step, one character shorter at a time, until the
trees together hold enough different candidates.  On the last step trees are
taken one after the other, so that no more are looked at than are wanted.  A query
in a crowd stops near the leaves, one in the open near the root.  Candidates are
ranked by their exact distance.

Vectors are dealt to forests of FOREST_ROWS by a hash of their row number, so a
forest fits in a task however vectors cluster, and recall does not depend on how many
forests there are.  Queries are dealt in blocks of BLOCK_QUERIES; a task joins
one forest with one block and returns the block's best k of that forest.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part; a query sees vectors of its own length only; a query never finds
its own row, but other rows with its id; equal distances go to the smaller id;
repeated rows are candidates of their own; with fewer candidates than k all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

TREES = 256
#: Characters of a string, one bit each.
DEPTH = 24
FOREST_ROWS = 16_384
BLOCK_QUERIES = 32_768
#: A query ascends to FACTOR x rows ** POWER candidates in a forest: the nearest rows of a
#: larger set are nearer, so a smaller share of it holds them.
FACTOR, POWER = 1.5, 0.83
SEED = 20_011
_HASH_ROWS = 2_048
_STEP_QUERIES = 128


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)
            & F.exists(vector, lambda x: x != 0.0))


def planes(dim: int, trees: int, depth: int, seed: int = SEED) -> np.ndarray:
    """Normals of random planes, one column a character: (dim, trees x depth)."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * depth), np.float32)


def strings(vectors: np.ndarray, normals: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees) strings of every vector as numbers, the first character highest."""
    depth = normals.shape[1] // trees
    values = np.uint32(1) << np.arange(depth - 1, -1, -1, dtype=np.uint32)
    out = np.empty((len(vectors), trees), np.uint32)
    for at in range(0, len(vectors), _HASH_ROWS):
        rows = vectors[at:at + _HASH_ROWS].astype(np.float32)
        bits = (rows @ normals > 0).reshape(len(rows), trees, depth)
        out[at:at + _HASH_ROWS] = np.where(bits, values, np.uint32(0)).sum(axis=2, dtype=np.uint32)
    return out


class Forest:
    """The sorted string arrays of one set of vectors: strings (rows, trees) of `depth` bits."""

    def __init__(self, numbers: np.ndarray, depth: int) -> None:
        self.rows, self.trees = numbers.shape
        self.depth = depth
        self.order = np.argsort(numbers, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(numbers.T, self.order, axis=1)

    def _ranges(self, numbers: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) where the strings begin and end that share `length` characters with each query."""
        rest = np.uint64((1 << (self.depth - length)) - 1)
        low = np.stack([np.searchsorted(s, q & ~rest) for s, q in zip(self.sorted, numbers, strict=True)])
        high = np.stack([np.searchsorted(s, q | rest, "right") for s, q in zip(self.sorted, numbers, strict=True)])
        return low, high

    def _marked(self, rows: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        out = rows.copy()
        out[np.concatenate(parts)] = True
        return out

    def candidates(self, numbers: np.ndarray, wanted: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each query the length of the prefix it stops at, and its candidates' rows in order.

        ``wanted`` different rows at least (all, if there are fewer).
        """
        for at in range(0, len(numbers), _STEP_QUERIES):
            yield from self._step(numbers[at:at + _STEP_QUERIES].T.astype(np.uint64), wanted)

    def _step(self, numbers: np.ndarray, wanted: int) -> Iterator[tuple[int, np.ndarray]]:
        # descent: what shares the longest prefixes, then one character less for all as long as any query needs it
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n = numbers.shape[1]
        begin = np.full(n, -1)
        for length in range(self.depth, -1, -1):
            ranges[length] = low, high = self._ranges(numbers, length)
            # a row counts once a tree here, so its different rows are no more than that
            begin[(begin < 0) & (((high - low).sum(axis=0) >= wanted) | (length == 0))] = length
            if begin.min() >= 0:
                break
        nothing = np.zeros(self.rows, bool)
        for q in range(n):
            length, held = int(begin[q]), nothing
            while True:
                if length not in ranges:
                    ranges[length] = self._ranges(numbers, length)
                low, high = (x[:, q].tolist() for x in ranges[length])
                parts = [o[a:b] for o, a, b in zip(self.order, low, high, strict=True)]
                found = self._marked(held, parts)
                if length == 0 or np.count_nonzero(found) >= wanted:
                    break
                held, length = found, length - 1
            few, enough = 0, len(parts)  # as many trees on the last step as it takes
            while enough - few > 1:
                middle = (few + enough) // 2
                part = self._marked(held, parts[:middle])
                if np.count_nonzero(part) >= wanted:
                    enough, found = middle, part
                else:
                    few = middle
            yield length, np.flatnonzero(found)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1).astype(np.float64)


def _searched(k: int, trees: int, depth: int, factor: float, power: float, seed: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One forest (left) and one block of queries (right) of the same dimension."""
        found: list[tuple[list, list, list]] = []
        if left.num_rows and right.num_rows:
            ids, own_rows, vectors = left["vec_id"].to_numpy(), left["row"].to_numpy(), _matrix(left["vector"])
            queries, vector_of = right["q_vec_id"].to_numpy(), _matrix(right["q_vector"])
            row_of = right["q_row"].to_numpy()
            normals = planes(vectors.shape[1], trees, depth, seed)
            forest = Forest(strings(vectors, normals, trees), depth)
            wanted = max(k + 1, int(factor * len(ids) ** power))
            for q, (_, rows) in enumerate(forest.candidates(strings(vector_of, normals, trees), wanted)):
                rows = rows[own_rows[rows] != row_of[q]]
                distance = np.sqrt(((vectors[rows] - vector_of[q]) ** 2).sum(axis=1))
                if len(rows) > k:
                    near = distance <= np.partition(distance, k - 1)[k - 1]
                    rows, distance = rows[near], distance[near]
                best = np.lexsort((ids[rows], distance))[:k]
                found.append(([queries[q]] * len(best), ids[rows[best]].tolist(), distance[best].tolist(),
                              [row_of[q]] * len(best)))
        flat = [[x for part in column for x in part] for column in zip(*found, strict=True)] or [[]] * 4
        return pa.table({"query_id": pa.array(flat[0], pa.int64()), "vec_id": pa.array(flat[1], pa.int64()),
                         "score": pa.array(flat[2], pa.float64()), "query_row": pa.array(flat[3], pa.int64())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES, depth: int = DEPTH,
           forest_rows: int = FOREST_ROWS, block_queries: int = BLOCK_QUERIES,
           factor: float = FACTOR, power: float = POWER, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row.

    vectors has vec_id and embedding; depth is 32 at most.  `row` tells rows apart that share their id.
    """
    given = vectors.schema["embedding"].dataType.simpleString()
    kept = F.col("embedding") if given == "array<float>" else F.col("embedding").cast("array<double>")
    # written, so that a row has the same number whenever it is read
    numbered = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), kept.alias("vector"))
                       .where(usable(F.col("vector"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = numbered.select(F.count("*"), F.count_if(is_query)).first()
    forests, query_blocks = max(1, -(-n // forest_rows)), max(1, -(-n_queries // block_queries))
    spread = lambda name, count: F.pmod(F.xxhash64("row", F.lit(name)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    keys = ["dim", "forest", "block"]
    rows = numbered.withColumn("dim", F.size("vector"))
    index = rows.withColumn("forest", spread("forest", forests)).withColumn("block", each(query_blocks))
    queries = rows.where(is_query).withColumn("block", spread("block", query_blocks)).withColumn(
        "forest", each(forests))
    # names of their own: both sides come from the same rows, and columns must not be taken for each other
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    found = index.groupBy(*keys).cogroup(queries.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(
        _searched(k, trees, depth, factor, power, seed),
        "query_id long, vec_id long, score double, query_row long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
