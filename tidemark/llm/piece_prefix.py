"""Merge-type pieces (SentencePiece) by a table of prefixes.

A text's pieces come from merges: of all adjacent pairs whose joint string is a
piece the one with the best score merges first, the leftmost of equals.  Such an
encoding has one last piece for every prefix of the text, and that of a longer
prefix goes on from it.  So no merge need be run on a text: an automaton
(Aho-Corasick over all pieces) reports which pieces end at a place, and the one
whose pair with the last piece of the prefix before it stays apart is the
prefix's last piece.  The table is filled from left to right, the pieces are read
off from the end.

Whether two pieces stay apart (Pieces.apart) is found by undoing their merges
from the latest on: if at some time the two symbols that face each other would
have merged first, they do not.  It needs pieces that never score better than
their parts, which holds for trained models and is checked; else the merges of
the pair are run.

Characters that are no piece become their UTF-8 bytes' pieces, or the unknown id
in a model without those; a run of unknown characters is then one id.

Texts are cut before a run of space marks that follows another character, around
line ends and between letters and stops, each only if no piece reaches over such
a cut (checked); every segment is then looked up or encoded by itself, and the
ids are those of the whole text.

Cases: null or empty text gives no ids and the empty text back; control pieces
written inside a text are ordinary text; repeated rows are repeated; a null id
stays null; a character that was a space mark in the text is a space afterwards,
as with the library; an empty table gives no rows.  Models with another
normaliser than identity are refused.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm.segments import SegmentCache

MARK = "▁"  # stands for a space in pieces (fixed value)
_CUT = "\0"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
MAX_PAIRS = 1_000_000
#: Look-ups are cheaper than tables of prefixes, so every short segment is kept.
MAX_SEGMENTS = 500_000


class Pieces:
    """Pieces with ranks (0 is the best score, equal scores share one) and their merges."""

    def __init__(self, scores: dict[str, float]) -> None:
        order = {s: n for n, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items()}
        self._worst = len(order)
        self._parts: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Whether undoing merges from the worst rank down undoes them from the last one on.
        self.ordered = all(len(half) == 1 or self.ranks[half] <= rank for piece, rank in self.ranks.items()
                           for half in self.parts(piece) or ())

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The merges as they run: the pieces left, and the parts of the last merge."""
        symbols, last = list(text), None
        while True:
            found = [(rank, i) for i in range(len(symbols) - 1)
                     if (rank := self.ranks.get(symbols[i] + symbols[i + 1])) is not None]
            if not found:
                return symbols, last
            _, i = min(found)
            last = symbols[i], symbols[i + 1]
            symbols[i:i + 2] = [last[0] + last[1]]

    def parts(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes the piece; none for a character."""
        if piece not in self._parts:
            symbols, last = self.merged(piece)
            self._parts[piece] = last if len(symbols) == 1 else None
        return self._parts[piece]

    def made(self, piece: str) -> bool:
        """Whether merges ever make the piece."""
        return len(piece) == 1 or self.parts(piece) is not None

    def apart(self, pair: tuple[str, str]) -> bool:
        """Whether the two stay two pieces when they stand side by side."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        found = self._undone(*pair) if self.ordered else self.merged(pair[0] + pair[1])[0] == list(pair)
        self.pairs[pair] = found
        return found

    def _undone(self, left: str, right: str) -> bool:
        limit, border_first = self._worst, False  # the border merges if it is better, or as good and further left
        while True:
            joint = self.ranks.get(left + right)
            if joint is not None and (joint < limit or border_first and joint == limit):
                return False
            a, b = self.parts(left), self.parts(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and self.ranks[left] > self.ranks[right]:
                limit, border_first, left = self.ranks[left], False, a[1]
            else:
                limit, border_first, right = self.ranks[right], True, b[0]


class Model:
    """A model file: its pieces and what it says about spaces and unknown characters."""

    def __init__(self, path: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules, kinds = proto.normalizer_spec, proto.SentencePiece
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only merge-type models with space marks before words are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.lead = MARK if rules.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.byte_ids = [i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.fallback = proto.trainer_spec.byte_fallback


class PrefixEncoder(SegmentCache):
    """batch(column): ids of whole texts; ids_of(text): those of one normalised text or segment."""

    def __init__(self, path: str, max_cached: int = MAX_SEGMENTS) -> None:
        super().__init__(self._encode, lead=False, max_cached=max_cached, meetings=1)
        self._model = Model(path)
        self._pieces = Pieces(self._model.scores)
        self._automaton = ahocorasick.Automaton()
        for piece in self._model.ids:
            if self._pieces.made(piece):
                self._automaton.add_word(piece, piece)
        self._automaton.make_automaton()
        self._cut_marks = not any(MARK in p.lstrip(MARK) for p in self._model.ids)
        self._cut_lines = self._model.fallback and not any("\n" in p for p in self._model.ids)
        after_letter = "".join({b for p in self._model.ids for b in re.findall(f"(?<={_LETTER}).", p, re.DOTALL)})
        self._cut_before = "".join(c for c in ",.;:!?" if c not in after_letter)

    def last_pieces(self, text: str) -> list[str]:
        """For every prefix, from the shortest on, the last piece of its encoding."""
        last: list[str] = []
        known, apart, n = self._pieces.pairs.get, self._pieces.apart, 0
        for end, piece in self._automaton.iter(text):
            if end < n:
                continue
            if end > n:  # no piece ends there: unknown characters
                last.extend(text[n:end])
                n = end
            size = len(piece)
            if size <= end:
                pair = last[end - size], piece
                if not (apart(pair) if (fits := known(pair)) is None else fits):
                    continue
            last.append(piece)
            n += 1
        last.extend(text[n:])
        return last

    def ids_of(self, text: str) -> list[int]:
        """The ids, read off the table of prefixes from the end."""
        last, end, out = self.last_pieces(text), len(text) - 1, []
        ids, known = self._model.ids.get, True
        while end >= 0:
            piece = last[end]
            end -= len(piece)
            own = ids(piece)
            if own is not None:
                out.append(own)
                known = True
            elif self._model.fallback:
                out.extend([self._model.byte_ids[b] for b in reversed(piece.encode())])
            elif known:  # unknown characters side by side are one id
                out.append(self._model.unknown)
                known = False
        out.reverse()
        return out

    def _normalised(self, column: pa.Array) -> pa.Array:
        marked = pc.replace_substring(column, " ", MARK)
        if not self._model.lead:
            return marked
        led = pc.binary_join_element_wise(self._model.lead, marked, "")
        return pc.if_else(pc.equal(column, ""), "", led)

    def _cut(self, column: pa.Array) -> pa.Array:
        column = self._normalised(column)
        if self._cut_marks:
            column = pc.replace_substring(column, MARK, f"{_CUT}{MARK}")
            for _ in range(2):  # runs of marks: the first pass joins pairs, the second the pairs
                column = pc.replace_substring(column, f"{MARK}{_CUT}{MARK}", MARK + MARK)
        if self._cut_lines:
            column = pc.replace_substring(column, "\n", f"{_CUT}\n{_CUT}")
        if self._cut_before:
            column = pc.replace_substring_regex(column, f"({_LETTER})([{self._cut_before}])", rf"\1{_CUT}\2")
        return pc.split_pattern(column, _CUT)

    def _slice(self, column: pa.Array) -> list[np.ndarray]:
        out = super()._slice(pc.if_else(pc.match_substring(column, _CUT), "", column))
        for row in np.flatnonzero(pc.match_substring(column, _CUT).to_numpy(zero_copy_only=False)).tolist():
            whole = self._model.lead + column[row].as_py().replace(" ", MARK)  # holds the cut mark itself
            out[row] = np.array(self.ids_of(whole), np.uint32)
        return out

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", self.ids_of(part)).tobytes() for part in parts]


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> tuple[PrefixEncoder, sentencepiece.SentencePieceProcessor, list[str]]:
    """One encoder per worker process, the library for decoding, and every id in decimal."""
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    return PrefixEncoder(path), library, [str(i) for i in range(library.get_piece_size())]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)[0]
        for batch in batches:
            for at, found in encoder.batch(batch.column(1)):
                yield pa.record_batch({"doc_id": batch.column(0).slice(at, len(found)),
                                       "ids": pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, ids array<int>"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library, decimal = shared_encoder(path)
        for batch in batches:
            for at, found in encoder.batch(batch.column(1)):
                counts, ids_sha, text_sha = [], [], []
                for ids in (x.tolist() for x in found):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(library.decode(ids).encode()).hexdigest())
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(at, len(found)), "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(ids_sha, pa.string()),
                    "decoded_sha256": pa.array(text_sha, pa.string())})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
