import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_ball as S


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_edges(spark, edge_docs, no_docs):
    docs = edge_docs.collect()
    fps = [plain_fingerprint(d.text or "") for d in docs]
    roots = plain_components(fps)
    ids = {}
    for d, r in zip(docs, roots, strict=True):
        if d.doc_id is not None:
            ids[r] = min(ids.get(r, d.doc_id), d.doc_id)
    want = sorted((d.doc_id or 0, f"{f:016x}", ids.get(r)) for d, f, r in zip(docs, fps, roots, strict=True))
    got = S.near_duplicates(edge_docs).collect()
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == want
    assert S.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_span_what_all_pairs_span(spark, seed):
    """Dense balls around a few centres: buckets of every length, distances 1 to 3 inside and between holes."""
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = {0}
    for c in centres:
        spots = [rng.choice(64, 64, replace=False) if seed == 1 else rng.permutation(np.r_[0:12, 30:36])][0]
        for _ in range(120):
            flips = rng.choice(spots[:18], rng.integers(0, 5), replace=False)
            fps.add(c ^ sum(1 << int(b) for b in flips))
        fps.add(c ^ 0b111)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = S.links(frame)
    for r in edges.collect():
        assert (r.a % 2**64 ^ r.b % 2**64).bit_count() <= 3
    got = {r.node: r.root for r in S.components(edges).collect()}
    parts, want = {}, {}
    for s, r in zip(signed, plain_components(fps), strict=True):
        parts.setdefault(got.get(s, s), set()).add(s)
        want.setdefault(r, set()).add(s)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_long_path_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = S.components(edges).collect()
    assert {r.node for r in got} == set(range(1, 301)) and {r.root for r in got} == {0}


def test_emits_a_variant_in_the_middle_of_any_three_bits():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = int(rng.integers(0, 2**63))
        y = x ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        keys = []
        for f in (x, y):
            column = pa.array(np.array([f], np.uint64).view(np.int64))
            [out] = S._emit(iter([pa.record_batch({"fp": column})]))
            keys.append(set(out.column(0).to_pylist()))
        assert len(keys[0]) == 196 and keys[0] & keys[1]
