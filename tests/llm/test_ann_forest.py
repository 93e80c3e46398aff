import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann_forest as A


def brute(rows, query, k):
    """rows: (id, vector); the query's own row is left out."""
    qid, q, own = query
    found = []
    for i, (vid, v) in enumerate(rows):
        if v is None or len(v) != len(q) or i == own or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        found.append((float(np.sqrt(((np.array(v, float) - np.array(q, float)) ** 2).sum())), vid))
    return sorted(found)[:k]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows],
                                 "vec_id long, embedding array<float>, row int, chars string, dim int")


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [0.0, 0.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0]), (0, [1.0, 0.0]), (10, [-1.0, 0.5])]
    got = {}
    for r in A.search(frame(spark, rows), F.col("vec_id").isin(0, 2, 9, 3), k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 2]  # 9 has nobody of its length, 3 takes no part
    own = brute(rows, (0, [1.0, 0.0], 0), 3)
    assert sorted(got[0]) == sorted([(i + 1, v, s) for i, (s, v) in enumerate(own)] * 2)
    assert [(v, s) for _, v, s in sorted(got[2])] == [(v, s) for s, v in brute(rows, (2, [0.0, 1.0], 2), 3)]
    assert A.search(frame(spark, rows).where("false"), F.col("vec_id") >= 0).count() == 0


def test_recall_and_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16))
    x[::3] = x[0] + 0.01 * rng.standard_normal((1000, 16))  # a third of the rows in one place
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    docs = frame(spark, rows).select("vec_id", "embedding")
    found = A.search(docs, F.col("vec_id") % 50 == 0, k=10, forest_rows=700, block_queries=25).collect()
    x = np.array([v for _, v in rows])
    hits = 0
    for q in range(0, 3000, 50):
        distance = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        near = set(np.lexsort((np.arange(3000), distance))[:10].tolist())
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(s == distance[v] for _, v, s in own)
        hits += len(near & {v for _, v, _ in own})
    assert hits / 600 >= 0.9


def test_forest_descends_and_ascends():
    strings = np.array([[0b0110], [0b0111], [0b1000], [0b0110]], np.uint32)
    forest = A.Forest(strings, 4)
    got = [next(forest.candidates(strings[:1], n)) for n in (1, 3, 4, 9)]
    assert [(length, rows.tolist()) for length, rows in got] == [
        (4, [0, 3]), (3, [0, 1, 3]), (0, [0, 1, 2, 3]), (0, [0, 1, 2, 3])]
    # the last step takes as many trees as it needs, and a row that several trees find counts once
    forest = A.Forest(np.array([[0, 0], [0, 0], [1, 0], [3, 3]], np.uint32), 2)
    assert [(n, rows.tolist()) for n, rows in forest.candidates(np.array([[0, 0]], np.uint32), 2)] == [(2, [0, 1])]
    assert [(n, rows.tolist()) for n, rows in forest.candidates(np.array([[0, 0]], np.uint32), 3)] == [(2, [0, 1, 2])]


@pytest.mark.parametrize("folder, whole", [("sf0.01", 0.6), ("sf0.1", 0.5)])
def test_recall_on_the_given_vectors(spark, folder, whole):
    """With the query's own parameters: recall, stops of several lengths, and far from all rows looked at."""
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], np.float64)
    normals = A.planes(x.shape[1], A.TREES, A.DEPTH)
    strings = A.strings(x, normals, A.TREES)
    stops = list(A.Forest(strings, A.DEPTH).candidates(strings[::10], int(A.FACTOR * len(x) ** A.POWER)))
    lengths = {length for length, _ in stops}
    assert len(lengths) > (folder == "sf0.1") and min(lengths) > 0 and max(lengths) < A.DEPTH
    assert max(len(rows) for _, rows in stops) < whole * len(x)
    hits, found = 0, {}
    for r in A.search(table, F.col("vec_id") % 10 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, len(x), 10):
        distance = ((x - x[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        hits += len(found[q] & set(np.argsort(distance, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * len(x)
