import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_blocks as B
from tidemark.llm.segments import SegmentEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([(0.5,), (0.9,), B.PERCENTILES]))
def test_blocks_round_trip(ids, percentiles):
    ids = np.array(ids, np.uint32)
    starts, raw = B.pack_blocks(ids, percentiles)
    assert (B.unpack_blocks(starts, np.frombuffer(raw, np.uint8), len(ids)) == ids).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(128, 7, np.uint32)
    ids[5] = 2**31
    starts, raw = B.pack_blocks(ids)
    assert len(raw) == 6 + 5 and raw[4] == 0 and raw[5] == 1


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 127, 128, 129, 1000, 0, 3)]
    part = B.Part(B.to_bytes([None, *range(1, 8)], docs))
    assert part.doc_ids == [None, *range(1, 8)]
    for k, ids in enumerate(docs):
        assert (part.document(k) == ids).all()
    with pytest.raises(ValueError):
        B.Part(b"nonsense" * 10)


@pytest.mark.parametrize(("name", "lead"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list("ab'sÉé́İΣσ1.,!<|>\n\t\r \u0085 　\x1c日😀")), max_size=40), max_size=8))
def test_segments_give_the_ids_of_whole_texts(name, lead, texts):
    path = public_tokenizers.path(name)
    if name not in _held:
        _held[name] = SegmentEncoder(path, lead), Tokenizer.from_file(path)
    encoder, plain = _held[name]
    plain.encode_special_tokens = True
    got = [x.tolist() for _, part in encoder.batch(pa.array(texts, pa.string())) for x in part]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


_held = {}


def test_files(spark, edge_docs, no_docs, monkeypatch):
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    docs = edge_docs.collect()
    ids = [np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4") for d in docs]
    order = sorted(range(len(docs)), key=lambda i: (docs[i].doc_id is not None, docs[i].doc_id or 0, ids[i].astype("<u2").tobytes()))
    want, start = [], 0
    for i in order:
        want.append((docs[i].doc_id, start, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        start += len(ids[i])
    for files in (5, None):
        got = B.written_and_read(edge_docs, WORDS, 2, files=files).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert B.written_and_read(no_docs, WORDS, 2).count() == 0


def test_one_id_for_a_third_of_the_rows(spark, tmp_path):
    """Documents with the same id, or none, are cut into files like all others."""
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then id end as doc_id",
                                        "concat('word ', id) as text").persist()
    B.write_files(docs, str(tmp_path / "f"), WORDS, 2, False, files=12)
    files = spark.read.parquet(str(tmp_path / "f"))
    sizes = [r[0] for r in files.groupBy("file_no").sum("documents").select("sum(documents)").collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 10 and max(sizes) < 600
    rows = sorted(B.read_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id or -1 for r in rows] == sorted(r.doc_id or -1 for r in docs.collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
