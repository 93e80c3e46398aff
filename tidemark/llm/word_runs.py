"""Runs of repeated words by a dictionary of basic factors.

The dictionary names every factor whose length is a power of two: two factors of
length 2^k have the same name if they are the same words.  Names of one length
come from pairs of names of half of it, by one sort.

A run of period p is found at the smallest length L = 2^k >= p.  A factor of
length L inside it holds a whole period, which as a primitive word never meets
itself earlier than p on; so its successor, the next place of the same name, lies
exactly p further, and that one's successor 2p further, both within twice L.
Three places in such an arithmetic progression propose their difference as a
period.  A run of at least four periods has such a progression at its first word,
as 4p >= L + 2p, so none is missed.  Places side by side with the same
difference belong to one run; from the first to the last of them they propose it,
and the run is extended to both sides while words p apart are the same.  Equal
proposals are dropped.

Only factors that occur twice in a document are kept from one length to the next:
a longer factor recurs only if its halves do.

Documents are worked on together, in slices of SLICE_BYTES of text (a longer one
by itself); names never reach over documents.

Cases: null or empty text has no words and no runs; a null id takes no rewriting;
repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_PERIODS = 6, 4
SLICE_BYTES = 4 << 20
REPORT_COLUMNS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                  "runs_sha256 string, collapsed_sha256 string")


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for every pair, the same for the same pair."""
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64)


def _recurring(names: np.ndarray) -> np.ndarray:
    return np.bincount(names)[names] > 1


def _successors(places: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For every place the distance to the next place of the same name, 0 if there is none."""
    order = np.argsort(names, kind="stable")  # places ascend
    sorted_places, sorted_names = places[order], names[order]
    distance = np.zeros(len(places), np.int64)
    distance[order[:-1]] = np.where(sorted_names[1:] == sorted_names[:-1], np.diff(sorted_places), 0)
    return distance


def _extended(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray,
              low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [start, end) grown to both sides, inside [low, high), while words one period apart are the same."""
    start, end = start.copy(), end.copy()
    going = np.arange(len(start))
    while len(going):
        going = going[start[going] > low[going]]
        going = going[words[start[going] - 1] == words[start[going] - 1 + period[going]]]
        start[going] -= 1
    going = np.arange(len(start))
    while len(going):
        going = going[end[going] < high[going]]
        going = going[words[end[going]] == words[end[going] - period[going]]]
        end[going] += 1
    return start, end


def runs(words: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of every run, by document, start and period.

    ``words`` are word numbers of all documents one after the other, ``sizes``
    their counts; a run has at least min_words words and MIN_PERIODS periods.
    """
    n = len(words)
    ends = np.cumsum(sizes)
    document = np.repeat(np.arange(len(sizes)), sizes)
    end_of = ends[document] if n else np.zeros(0, np.int64)
    longest = int(sizes.max(initial=0)) // MIN_PERIODS  # of all periods
    name_of = np.full(n + 1, -1, np.int64)  # by place, -1 where the factor does not recur
    places = np.arange(n)
    names = _names(document, words)
    length, found = 1, []
    while n:
        kept = _recurring(names)
        places, names = places[kept], names[kept]
        if not len(places):
            break
        distance = _successors(places, names)
        at = np.zeros(n + 1, np.int64)
        at[places] = distance
        # the successor's successor lies as far again; shorter periods were found before
        meant = (distance > length // 2) & (distance <= length)
        proposers, step = places[meant], distance[meant]
        chained = at[proposers + step] == step
        proposers, step = proposers[chained], step[chained]
        if len(proposers):
            breaks = (np.diff(proposers) != 1) | (np.diff(step) != 0)
            start, last = proposers[np.append(True, breaks)], proposers[np.append(breaks, True)]
            period = step[np.append(True, breaks)]
            found.append((start, last + 2 * period + length, period))
        if length >= longest:
            break
        name_of[:] = -1
        name_of[places] = names
        right = places + length
        fits = right + length <= end_of[places]
        places, names, right = places[fits], names[fits], right[fits]
        pair = name_of[right]
        both = pair >= 0
        places, length = places[both], 2 * length
        names = _names(names[both], pair[both])
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    own = document[start]
    low, high = ends[own] - sizes[own], ends[own]
    start, end = _extended(words, start, end, period, low, high)
    long_enough = end - start >= np.maximum(min_words, MIN_PERIODS * period)
    rows = np.unique(np.stack([own, start - low, end - start, period], axis=1)[long_enough], axis=0)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def kept_words(sizes: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
    """False for words that any run holds after its first period."""
    document, start, length, period = found
    begin = (np.cumsum(sizes) - sizes)[document] + start
    depth = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(depth, begin + period, 1)
    np.add.at(depth, begin + length, -1)
    return np.cumsum(depth)[:-1] == 0


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts one after the other, and their number in each; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    there = pc.not_equal(flat, "")
    document = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    sizes = np.bincount(document[there.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return flat.filter(there), sizes.astype(np.int64)


def rewritten(doc_ids: list[int | None], sizes: np.ndarray) -> np.ndarray:
    """Place of the word that stands at each place after the rule of crc32(doc_id).

    One document in ten repeats a stretch of its own words from some word on.
    """
    places = np.arange(int(sizes.sum()))
    begins = (np.cumsum(sizes) - sizes).tolist()
    for doc, begin, n in zip(doc_ids, begins, sizes.tolist(), strict=True):
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        places[begin + a:begin + n] = begin + a + np.arange(n - a) % p
    return places


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    before = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + SLICE_BYTES, "right")) - 1)
        yield at, end
        at = end


def _joined(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The words of each document with one space between them."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, words), pa.scalar(" ", words.type))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def report_slice(doc_ids: pa.Array, texts: pa.Array, rewrite: bool) -> pa.RecordBatch:
    words, sizes = words_of(texts)
    if rewrite:
        words = words.take(pa.array(rewritten(doc_ids.to_pylist(), sizes)))
    found = runs(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    kept = kept_words(sizes, found)
    document = np.repeat(np.arange(len(sizes)), sizes)
    left = np.bincount(document[kept], minlength=len(sizes))
    collapsed = [_sha256(t.as_py() or "") for t in _joined(words.filter(pa.array(kept)), left)]
    of_doc: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for own, *run in zip(*(x.tolist() for x in found), strict=True):
        of_doc[own].append(tuple(run))
    best = [max(own, key=lambda r: (r[1], -r[0], -r[2])) if own else (None, None, None) for own in of_doc]
    nobody = _sha256("")
    listed = [_sha256("".join(f"{s},{n},{p}\n" for s, n, p in own)) if own else nobody for own in of_doc]
    start, length, period = zip(*best, strict=True)
    return pa.record_batch({
        "doc_id": doc_ids, "n_runs": pa.array([len(own) for own in of_doc], pa.int64()),
        "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
        "period": pa.array(period, pa.int64()),
        "exponent_milli": pa.array([None if n is None else 1000 * n // p for _, n, p in best], pa.int64()),
        "runs_sha256": pa.array(listed, pa.string()), "collapsed_sha256": pa.array(collapsed, pa.string())})


def report(docs: DataFrame, rewrite: bool = True) -> DataFrame:
    """One row per document: its runs, the longest of them, and digests of all runs and of the words kept.

    With ``rewrite`` the documents chosen by their id repeat some of their words
    first (rewritten()).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _slices(batch.column(1)):
                yield report_slice(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at), rewrite)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(work, REPORT_COLUMNS))


def run_rows(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run of every text as it stands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _slices(batch.column(1)):
                words, sizes = words_of(batch.column(1).slice(at, end - at))
                numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                own, start, length, period = runs(numbers, sizes)
                yield pa.record_batch({"doc_id": batch.column(0).slice(at, end - at).take(pa.array(own)),
                                       "start": pa.array(start), "length": pa.array(length),
                                       "period": pa.array(period)})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(work, "doc_id long, start long, length long, period long"))


def collapse(docs: DataFrame) -> DataFrame:
    """The rows of docs with every run cut to its first period: kept words joined by one space (null stays)."""
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            for at, end in _slices(batch.column(at_text)):
                part = batch.slice(at, end - at)
                text = part.column(at_text)
                words, sizes = words_of(text)
                numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                kept = kept_words(sizes, runs(numbers, sizes))
                left = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))
                new = _joined(words.filter(pa.array(kept)), left).cast(text.type)
                yield part.set_column(at_text, batch.schema.field(at_text),
                                      pc.if_else(pc.is_valid(text), new, pa.scalar(None, text.type)))

    return docs.mapInArrow(work, schema)
