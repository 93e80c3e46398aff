"""Byte-level BPE as a finite-state transducer, determinised as it runs.

A state is the last token sent and the bytes read since.  In it every place of
the pending bytes has the token that ends there in the encoding of the bytes up
to that place: the one whose pair with the token before is what the merges
themselves make of the two.  A place is alive while some token of the vocabulary
can still begin there, which a token's length bounds.  On a byte the transducer
moves to the next state and sends the tokens on the path that all places alive
share: whatever follows, they stay.  At the end of a piece it sends the rest.

States and moves are built when needed again.  Pieces recur, so a worker also
keeps the ids of segments between spaces.  All tables start anew at a limit;
results never depend on it.

Decoding joins the tokens' bytes and passes them through a UTF-8 machine that
holds back an incomplete character until its next bytes come.

Cases: null or empty text gives no ids; special strings are ordinary text; ranks
must run from 0 without gaps; ids outside them are refused; an empty table gives
no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.segments import SegmentCache

MAX_STATES = 400_000
#: Here a look-up saves more than in the library, so every segment is kept.
MAX_SEGMENTS = 800_000
_BYTES = [bytes((b,)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id, from a file of base64 and rank by line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merges:
    """The merge rule itself: the adjacent pair of lowest rank first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        # bytes that are a token (1), begin a longer one (2) or both (3)
        self.kinds = {token[:n]: 2 for token in ranks for n in range(1, len(token))}
        for token in ranks:
            self.kinds[token] = self.kinds.get(token, 0) | 1
        self._split: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """Plain merging, up to but without rank `below`."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1)
                     if (r := rank(parts[i] + parts[i + 1])) is not None and (below is None or r < below)]
            if not found:
                break
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def last_merge(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that make the token, none for a single byte."""
        if token not in self._split:
            parts = self.merged(token, self.ranks[token]) if len(token) > 1 else [token]
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def reachable(self, token: bytes) -> bool:
        return len(token) == 1 or self.last_merge(token) is not None

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the merges keep left and right apart, as two tokens.

        Undo merges from the highest rank down.  If at some time the two parts
        that face each other would merge before either grows, they do not fit.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._apart(left, right)
        return known

    def _apart(self, left: bytes, right: bytes) -> bool:
        ranks = self.ranks
        top = len(ranks)  # a merge over the border happens if its rank is below this
        tie = False  # an equal rank on the left goes first; the border goes before the right one
        while True:
            joint = ranks.get(left + right)
            if joint is not None and (joint < top or joint == top and tie):
                return False
            a, b = self.last_merge(left), self.last_merge(right)
            if a is None and b is None:
                return True
            # of the two merges undo the later: the higher rank, at equal rank the right one
            if b is None or a is not None and ranks[left] > ranks[right]:
                top, tie, left = ranks[left], False, a[1]
            else:
                top, tie, right = ranks[right], True, b[0]

    def forget(self) -> None:
        self._fits.clear()


class Transducer:
    """ids(piece): the token ids of one piece of bytes."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES) -> None:
        self._merges, self._max = merges, max_states
        self._reset()

    def _reset(self) -> None:
        self._merges.forget()
        self._numbers: dict[tuple[bytes, bytes], int] = {}
        self._states: list[tuple[bytes, bytes, list[bytes | None], list[int]]] = []
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._rest: dict[int, tuple[int, ...]] = {}
        self._wanted: set[int] = set()
        self._number(b"", b"", [b""], [0])

    def _number(self, last: bytes, pending: bytes, tokens: list[bytes | None], alive: list[int]) -> int:
        key = (last, pending)
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._states)
            self._states.append((last, pending, tokens, alive))
        return number

    def _ids(self, tokens: list[bytes | None], place: int) -> tuple[int, ...]:
        """Ids of the tokens on the way to a place."""
        way = []
        while place:
            way.append(self._merges.ranks[tokens[place]])
            place -= len(tokens[place])
        return tuple(reversed(way))

    def _step(self, last: bytes, pending: bytes, tokens: list[bytes | None], alive: list[int],
              byte: int) -> tuple[tuple[bytes, bytes, list[bytes | None], list[int]], tuple[int, ...]]:
        """What a state becomes on a byte, and the ids sent."""
        merges = self._merges
        pending += _BYTES[byte]
        end, found, kinds = len(pending), None, merges.kinds
        live = []
        for begin in alive:
            token = pending[begin:]
            kind = kinds.get(token, 0)
            if kind & 2:
                live.append(begin)
            if kind & 1 and found is None:
                before = tokens[begin] if begin else last
                if merges.fits(before, token) if before else merges.reachable(token):
                    found = token
        tokens = [*tokens, found]
        live.append(end)
        cut = live[0]
        if len(live) > 1 and cut:  # to the place that all of them come through
            places = set(live)
            while len(places) > 1:
                latest = max(places)
                places.remove(latest)
                places.add(latest - len(tokens[latest]))
            cut = places.pop()
        if not cut:
            return (last, pending, tokens, live), ()
        return ((tokens[cut], pending[cut:], [b"", *tokens[cut + 1:]], [p - cut for p in live]),
                self._ids(tokens, cut))

    def ids(self, piece: bytes) -> list[int]:
        """Along known moves as far as they go.

        A move is built when it is wanted for the second time: most pieces of a
        large text occur once, and their last bytes are walked without a trace.
        """
        if len(self._states) + len(self._wanted) // 4 > self._max:
            self._reset()
        state, out, moves, wanted = 0, [], self._moves, self._wanted
        for at, byte in enumerate(piece):
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                if key not in wanted:
                    wanted.add(key)
                    return out + self._walk(self._states[state], piece[at:])
                own, sent = self._step(*self._states[state], byte)
                move = moves[key] = self._number(*own), sent
            state, sent = move
            if sent:
                out.extend(sent)
        rest = self._rest.get(state)
        if rest is None:
            tokens = self._states[state][2]
            rest = self._rest[state] = self._ids(tokens, len(tokens) - 1)
        out.extend(rest)
        return out

    def _walk(self, state: tuple, piece: bytes) -> list[int]:
        out: list[int] = []
        for byte in piece:
            state, sent = self._step(*state, byte)
            out.extend(sent)
        out.extend(self._ids(state[2], len(state[2]) - 1))
        return out


class Encoder:
    """batch(column): token ids of whole texts, every new piece by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self._transducer = Transducer(Merges(ranks))
        self._pieces = regex.compile(pattern)
        self.batch = SegmentCache(self._encode, lead=True, max_cached=MAX_SEGMENTS, meetings=1).batch

    def _encode(self, parts: list[str]) -> list[bytes]:
        pieces, ids = self._pieces.findall, self._transducer.ids
        return [array("I", [i for piece in pieces(part) for i in ids(piece.encode())]).tobytes() for part in parts]


# First bytes of UTF-8 characters: from, to, bytes that follow, bounds of the next one (fixed values).
_LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF),
          (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF),
          (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
_BY_LEAD = {byte: rule[2:] for rule in _LEADS for byte in range(rule[0], rule[1] + 1)}


class Utf8Stream:
    """Bytes in, whole characters out; what is not UTF-8 becomes U+FFFD."""

    def __init__(self) -> None:
        self._held = b""

    @staticmethod
    def _open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for n in range(1, min(3, len(data)) + 1):
            rule = _BY_LEAD.get(data[-n])
            if rule is None:
                if not 0x80 <= data[-n] <= 0xBF:
                    return 0
                continue
            follow, low, high = rule
            return n if n <= follow and (n == 1 or low <= data[-n + 1] <= high) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self._held + data
        tail = self._open_tail(data)
        self._held = data[len(data) - tail:]
        return data[:len(data) - tail].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._held = self._held, b""
        return rest.decode("utf-8", "replace")


def decoded(ids: Sequence[int], tokens: list[bytes], step: int = 4096) -> Iterator[str]:
    """The text of token ids, in parts of `step` tokens as they come."""
    stream = Utf8Stream()
    for at in range(0, len(ids), step):
        yield stream.feed(b"".join([tokens[i] for i in ids[at:at + step]]))
    yield stream.close()


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    """One encoder per worker process, and the tokens by id."""
    ranks = load_ranks(path)
    return Encoder(ranks, pattern), sorted(ranks, key=ranks.__getitem__)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = shared_encoder(ranks_path, pattern)
        for batch in batches:
            for at, found in encoder.batch(batch.column(1)):
                yield pa.record_batch({"doc_id": batch.column(0).slice(at, len(found)),
                                       "ids": pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, ids array<int>"))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = shared_encoder(ranks_path, pattern)
        decimal = [str(i) for i in range(len(tokens))]
        for batch in batches:
            for at, found in encoder.batch(batch.column(1)):
                counts, ids_sha, text_sha = [], [], []
                for ids in (x.tolist() for x in found):
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                    digest = hashlib.sha256()
                    for part in decoded(ids, tokens):
                        digest.update(part.encode())
                    text_sha.append(digest.hexdigest())
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(at, len(found)), "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(ids_sha, pa.string()),
                    "decoded_sha256": pa.array(text_sha, pa.string())})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
