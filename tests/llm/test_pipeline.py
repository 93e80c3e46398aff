"""The pipeline against a plain run of the same decisions on the small tables."""

import sys
from pathlib import Path

import public_tokenizers
import pytest
from test_simhash_ball import plain_components, plain_fingerprint
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as C  # noqa: E402
from tidemark.llm import line_quality  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert "pipeline" in entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []
    assert [name for name, _ in C.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]


def run_stages(spark, docs, sf_dir="unused"):
    out = []
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_edges(spark, edge_docs, no_docs):
    stages = run_stages(spark, edge_docs)
    for stage in stages[:-1]:
        assert stage.columns == edge_docs.columns
    assert all(stage.count() == 0 for stage in run_stages(spark, no_docs))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_like_a_plain_run(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    clean = {i: line_quality.cleaned(t)[0] for i, t in docs.items() if line_quality.measures(t)["kept"]}
    ids = sorted(clean)
    roots = plain_components([plain_fingerprint(clean[i]) for i in ids])
    kept = [i for k, i in enumerate(ids) if roots[k] == k]
    tables = run_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert sorted(r.doc_id for r in tables[0].collect()) == ids
    assert sorted(r.doc_id for r in tables[1].collect()) == kept
    redacted = {r.doc_id: r for r in tables[2].collect()}
    assert sorted(redacted) == kept and all(r.n_chars == len(r.text) for r in redacted.values())
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {}
    for r in tables[3].collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in redacted.items()}
    assert C.run(spark, FOLDER).count() == tables[3].count()


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "some text here", "a", 5), (2, "some text here", "b", 6), (3, "another one", "c", 7)],
                                 "doc_id long, text string, _pipeline_row string, _row int")
    kept = C.near_duplicates(spark, docs, "unused")
    assert {tuple(r) for r in kept.collect()} == {(1, "some text here", "a", 5), (3, "another one", "c", 7)}


def test_only_the_result_stays(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("tidemark-*"))
    packed = C.run(spark, FOLDER)
    assert [p.name.split("-")[1] for p in set(folder.glob("tidemark-*")) - before] == ["packing"]
    assert packed.count() > 0


def test_one_row_of_a_group_stays(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(7, one), (7, one), (5, one), (5, one), (None, one), (None, two), (None, two), (3, three), (9, three), (9, two + " x"),
            (11, " ".join(f"d{i}" for i in range(40))), (12, one), (12, " ".join(f"e{i}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = C.near_duplicates(spark, docs, "unused")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or -1), r.text.split()[0]) for r in kept.collect())
    near = plain_components([plain_fingerprint(t) for t in (two, two + " x")])[1] == 0
    want = [(3, "c0"), (5, "a0"), (9, "b0"), (11, "d0"), (12, "e0")] + ([] if near else [(-1, "b0")])
    assert got == sorted(want)
