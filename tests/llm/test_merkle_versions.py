import hashlib
import zlib

import pytest

from tidemark.llm import merkle_versions as mv
from tidemark.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([sha("".join(row[i:i + 2])) for i in range(0, len(row), 2)])
    return out


def leaf_of(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    fields = [None if v is None else str(v) for v in (r.doc_id, r.source, r.lang, n, r.text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def fold(value, levels, place):
    beside = []
    for row in levels[:-1]:
        mine, other = place, place ^ 1
        if other < len(row):
            beside.append(row[other])
            value = sha(row[other] + value if mine & 1 else value + row[other])
        else:
            value = sha(value)
        place >>= 1
    return value, beside


def want(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by_lang[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees[g] = levels_of([leaf_of(r) for r in by_lang[g]])
    top = levels_of([trees[g][-1][0] for g in langs])
    root = top[-1][0]
    out = []
    for at, g in enumerate(langs):
        for place, r in enumerate(by_lang[g]):
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            own = leaf_of(r, 1) if bad else leaf_of(r)
            _, beside = fold(own, trees[g], place)
            sub, _ = fold(own, trees[g], place)
            folded, higher = fold(sub, top, at)
            out.append((r.doc_id, leaf_of(r), trees[g][-1][0], root, sha("".join(beside + higher)), folded, folded == root))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (0, 3), (9, 1, 16), (70, 5, 64, 2, 33)])
def test_storeys_against_brute_force(spark, sizes):
    rows = [(100 * g + i // 2, f"t{i}", [None, "de", "en", "fr", "ß"][g], f"s{i % 3}", i if i % 4 else None)
            for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert got(mv.manifest(docs, levels=2, range_rows=10)) == want(docs.collect())


def test_edges(spark, edge_docs, no_docs):
    assert got(mv.manifest(edge_docs)) == want(edge_docs.collect())
    assert mv.manifest(no_docs).count() == 0 and mv.copied_nodes(no_docs).count() == 0
    most = spark.createDataFrame([(3, "t", "en", "s", 2 ** 63 - 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert mv.manifest(most).first().verified


def test_versions_share_all_but_the_ancestors():
    leaves = [sha(str(i)) for i in range(11)]
    tree = mv.Tree(leaves, 4)

    def nodes(node):
        return {id(node): node} if node[1] is None else {
            id(node): node, **nodes(node[1]), **(nodes(node[2]) if node[2] else {})}

    for place in range(11):
        version = tree.changed(place, "x")
        assert len(nodes(version).keys() - nodes(tree.root).keys()) == 5
        assert version[0] == mv.Tree([*leaves[:place], "x", *leaves[place + 1:]], 4).root[0]
        assert mv.continued("x", tree.path(place)) == version[0]


def test_nodes_of_versions(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 2], "s", i) for i in range(60)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    bad = {r.doc_id: r.folded_root for r in mv.manifest(docs, levels=2, range_rows=16).collect() if not r.verified}
    assert set(bad) == {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}
    nodes = mv.copied_nodes(docs, levels=2, range_rows=16).collect()
    tops = {2 * r.place + "ab".index(r.own_group): r.node for r in nodes if r.level == 6}
    assert tops == bad and len(nodes) == 7 * len(bad)


def test_query_against_brute_force(spark):
    frame = QUERIES["op11_merkle_versions"](spark, "/root/testdata/sf0.001")
    assert got(frame) == want(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
