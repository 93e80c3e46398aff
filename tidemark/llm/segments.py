"""Whole texts to token ids with the tokenizers library, one segment at a time.

Texts are cut into segments and every segment's ids are looked up; only those
that a worker has not met yet go to the library.  So a word that occurs a
million times costs one call and a look-up for each occurrence.  The cuts give
exactly the ids of the whole text:

* A vocabulary that drops white space (lead=False) never joins characters over a
  space or line end, and its normaliser neither composes nor lowers across one.
* A byte-level vocabulary (lead=True) takes a space into the piece that follows.
  Cutting before a space changes its pieces only where a run of white space
  reaches over the cut, that is where a space stands between two white
  characters or after one at the very end; such texts are encoded whole.  Line
  ends are pieces of their own where no other white space touches them.
* Between a letter and one mark before white space there is always a cut.  Only
  letters are taken that have one character when lowered.

Memory: texts are worked on in slices of SLICE_BYTES, a longer text by itself; the
cache has two halves of MAX_CACHED entries together, of which the older is dropped
whenever the younger is full and takes over what is met again; a segment is kept
from its second meeting on, if so told (most words of a large text occur once), and never if
it is longer than MAX_LENGTH.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Whatever any regular-expression library counts as white space (fixed values).
_WHITE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]")
_RUN_OVER_CUT = rf"{_WHITE} (?:{_WHITE}|\z)"
_TOUCHED_LINE_END = rf"{_WHITE}\n|\n{_WHITE}"
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([,.;:!?])([ \n]|\z)"
_CUT = "\0"
#: Text that is worked on at a time, and the most entries that a worker keeps.
SLICE_BYTES = 8 << 20
MAX_CACHED = 500_000
MAX_LENGTH = 64
_MET_MASK = (1 << 22) - 1


class SegmentCache:
    """Ids of whole texts from an `encode` that sees every new segment once, as bytes of uint32."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], lead: bool, max_cached: int = MAX_CACHED,
                 meetings: int = 2) -> None:
        """meetings: how often a segment is met before it is kept, once (1) or twice (2)."""
        self._encode, self._lead, self._max_cached, self._meetings = encode, lead, max_cached, meetings
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._met = bytearray(_MET_MASK + 1)

    def batch(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of the rows from there on), slice by slice; null is empty."""
        column = pc.fill_null(column, "")
        before = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(before, before[at] + SLICE_BYTES, "right")) - 1)
            yield at, self._slice(column.slice(at, end - at))
            at = end

    def _slice(self, column: pa.Array) -> list[np.ndarray]:
        over = pc.match_substring(column, _CUT)
        if self._lead:
            over = pc.or_(over, pc.match_substring_regex(column, _RUN_OVER_CUT))
        uncut = np.flatnonzero(over.to_numpy(zero_copy_only=False))
        whole = column.take(pa.array(uncut)).to_pylist()
        parts = self._cut(pc.if_else(over, "", column))
        flat = parts.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        values = self._values(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        begin = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join(values), np.uint32)
        own = sizes[codes]
        ends = np.cumsum(own)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        places = np.repeat((begin[codes] - (ends - own)).astype(kind), own)
        places += np.arange(ends[-1], dtype=kind)
        ids = ids[places]
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        out = np.split(ids, np.concatenate([[0], ends])[starts[1:-1]])
        for row, text in zip(uncut.tolist(), whole, strict=True):
            out[row] = np.frombuffer(self._encode([text])[0], np.uint32)
        return out

    def _cut(self, column: pa.Array) -> pa.Array:
        """Lists of segments; with lead each keeps the space before it."""
        if not self._lead:
            plain = pc.replace_substring(column, "\n", " ")
            return pc.split_pattern(pc.replace_substring_regex(plain, _MARK, r"\1 \2\3"), " ")
        column = pc.replace_substring_regex(column, _MARK, rf"\1{_CUT}\2\3")
        touched = pc.match_substring_regex(column, _TOUCHED_LINE_END)
        lines = pc.replace_substring(column, "\n", f"{_CUT}\n{_CUT}")
        return pc.split_pattern(pc.replace_substring(pc.if_else(touched, column, lines), " ", f"{_CUT} "), _CUT)

    def _values(self, words: list[str]) -> list[bytes]:
        """The segments' ids; short ones stay known."""
        known, older = self._known, self._older
        values = list(map(known.get, words))
        new = [i for i, value in enumerate(values) if value is None]
        for i in new:
            values[i] = older.get(words[i])
        known.update([(words[i], values[i]) for i in new if values[i] is not None])
        new = [i for i in new if values[i] is None]
        for i, value in zip(new, self._encode([words[i] for i in new]), strict=True):
            values[i] = value
        met, places = self._met, [hash(words[i]) & _MET_MASK for i in new]
        known.update([(words[i], values[i]) for i, p in zip(new, places, strict=True)
                      if met[p] + 1 >= self._meetings and len(words[i]) <= MAX_LENGTH])
        for p in places:
            met[p] = 1
        if 2 * len(known) > self._max_cached:
            self._older, self._known, self._met = known, {}, bytearray(_MET_MASK + 1)
        return values


class SegmentEncoder:
    """batch(column): token ids of whole texts by the tokenizers library.

    Strings of special tokens inside a text are ordinary text: a document must
    not be able to end itself.
    """

    def __init__(self, vocabulary: str, lead: bool, row: int = 64) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.encode_special_tokens = True
        self._row, self._between = row, "" if lead else " "
        self.batch = SegmentCache(self._encode, lead).batch

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Words of letters go to the library in rows, each one piece there; all else one by one."""
        head = 0 if self._between else 1
        own: dict[str, bytes] = {}
        words = [p for p in parts if p[head:].isalpha() and (not head or p[0] == " ")]
        rows = [words[i:i + self._row] for i in range(0, len(words), self._row)]
        encoded = self._tokenizer.encode_batch([self._between.join(r) for r in rows], add_special_tokens=False)
        for row, found in zip(rows, encoded, strict=True):
            ids, piece = array("I", found.ids).tobytes(), np.array(found.word_ids)
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            if len(starts) == len(row):  # else a letter became something else when lowered
                ends = [*(4 * starts[1:]).tolist(), len(ids)]
                own.update(zip(row, [ids[a:b] for a, b in zip((4 * starts).tolist(), ends, strict=True)], strict=True))
        rest = [p for p in parts if p not in own]
        own.update((p, array("I", x.ids).tobytes()) for p, x in
                   zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        return [own[p] for p in parts]


@functools.lru_cache(maxsize=2)
def shared_encoder(vocabulary: str, lead: bool) -> SegmentEncoder:
    """One encoder per worker process, so that the tasks it runs share the segments seen so far."""
    return SegmentEncoder(vocabulary, lead)
