import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import piece_prefix as pp
from tidemark.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "e", "th", "in", " ", "  ", " " * 7, " " * 16, "\n", "\t", "▁", "é", "日", "😀", "1", ".", "\0", "\r",
         "x", "ing", "The", "-", "==", "ß", "ا", "ени", "<s>", "<0x0A>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoder():
    return pp.PrefixEncoder(MODEL)


def batch(encoder, texts):
    return [ids.tolist() for _, found in encoder.batch(pa.array(texts, pa.string())) for ids in found]


def test_as_the_library(library, encoder):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [" " * n + "a" * (n % 3) for n in range(100)]  # marks have equal scores: the leftmost go first
    assert batch(encoder, texts) == library.encode(texts)
    assert [encoder.ids_of(pp.MARK + t.replace(" ", pp.MARK)) if t else [] for t in texts] == library.encode(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, encoder, text):
    assert batch(encoder, [text]) == [library.encode(text)]


def test_a_small_cache_changes_nothing(library):
    encoder = pp.PrefixEncoder(MODEL, max_cached=8)
    texts = [f"word{i % 50} and, more. {i}" for i in range(200)]
    assert batch(encoder, texts) == batch(encoder, texts) == library.encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=2, max_size=5), st.integers(-6, 0), max_size=12), st.text("abc", max_size=14))
def test_pairs_against_the_merges(scores, text):
    """Any vocabulary, also one whose pieces score better than their parts, or alike."""
    pieces = pp.Pieces({"a": -9.0, "b": -9.0, "c": -9.0, **scores})
    got = pieces.merged(text)[0]
    for left, right in zip(got, got[1:], strict=False):
        assert pieces.apart((left, right))
    whole = {piece: pieces.merged(piece)[0] == [piece] for piece in scores}
    assert whole == {piece: pieces.made(piece) for piece in scores}
    for left in [p for p in pieces.ranks if pieces.made(p)]:
        for right in [p for p in pieces.ranks if pieces.made(p)]:
            assert pieces.apart((left, right)) == (pieces.merged(left + right)[0] == [left, right])


def test_query_against_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in
           QUERIES["op13_piece_prefix"](spark, folder).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert not got


def test_edges(spark, edge_docs, no_docs, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pp.round_trip(edge_docs, MODEL).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = set()
    for r in edge_docs.collect():
        ids = library.encode(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
    assert pp.round_trip(edge_docs, MODEL).count() == edge_docs.count()
    assert pp.round_trip(no_docs, MODEL).count() == 0
    ids = {r.doc_id: r.ids for r in pp.encode(edge_docs.where("doc_id < 10"), MODEL).collect()}
    assert ids[3] == library.encode("one")
