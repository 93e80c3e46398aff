import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe_fst as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    return [x.tolist() for _, part in encoder.batch(pa.array(texts, pa.string())) for x in part]


def test_ranks_are_read(ranks):
    with open(PATH, "rb") as file:
        token, rank = file.readline().split()
    assert ranks[base64.b64decode(token)] == int(rank) and sorted(ranks.values()) == list(range(len(ranks)))


def test_like_the_library(ranks, plain):
    rng = random.Random(5)
    letters = "ab'sÉé Σσ1.,\n\t \r  ́\x1c\x85\0 <|endoftext|>日本語한국😀👍🏽the ingand"
    tokens = list(ranks)
    texts = ["", " ", "  ", "\n", "a" * 5000, "ab" * 300, "=-" * 200, "é" * 500, "a\0 b"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [b"".join(rng.choice(tokens) for _ in range(6)).decode("utf8", "ignore") for _ in range(3000)]
    assert encoded(B.Encoder(ranks, PATTERN), texts) == [plain.encode_ordinary(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(data=st.binary(max_size=30))
def test_transducer_on_any_bytes(ranks, plain, data):
    assert B.Transducer(_merges(ranks)).ids(data) == plain._encode_single_piece(data) if data else True


_held = []


def _merges(ranks):
    if not _held:
        _held.append(B.Merges(ranks))
    return _held[0]


def test_lookahead_is_bounded_and_tables_restart(ranks, plain):
    machine = B.Transducer(_merges(ranks), max_states=50)
    for text in ["international", "abababab", "running runners", "é" * 9, "x" * 40] * 3:
        assert machine.ids(text.encode()) == plain._encode_single_piece(text.encode())
    longest = max(map(len, ranks))
    assert max(len(pending) for _, pending, _, _ in machine._states) <= 2 * longest


@settings(max_examples=200, deadline=None)
@given(data=st.binary(max_size=40), cuts=st.lists(st.integers(0, 40), max_size=6))
def test_utf8_stream(data, cuts):
    stream, at, out = B.Utf8Stream(), 0, ""
    for cut in sorted(cuts):
        out += stream.feed(data[at:cut])
        at = max(at, cut)
    assert out + stream.feed(data[at:]) + stream.close() == data.decode("utf-8", "replace")


def test_unknown_id(ranks):
    with pytest.raises(IndexError):
        list(B.decoded([10**9], [b"a"]))


def test_edges(spark, edge_docs, no_docs, plain):
    got = B.round_trip(edge_docs, PATH, PATTERN).collect()
    want = []
    for d in edge_docs.collect():
        ids = plain.encode_ordinary(d.text or "")
        want.append((d.doc_id or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((d.text or "").encode()).hexdigest()))
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted(want)
    assert B.round_trip(no_docs, PATH, PATTERN).count() == 0
    ids = {r.doc_id: r.ids for r in B.encode(edge_docs, PATH, PATTERN).collect()}
    assert ids[11] == plain.encode_ordinary(next(d.text for d in edge_docs.collect() if d.doc_id == 11))
