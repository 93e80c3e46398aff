"""Line-first quality rules.

Every line is judged by itself and lines that fail are removed; a document that
loses too much of its words is then rejected.  A line fails by

* punctuation: marks of shouting or symbols on many of its words; one word over and
  over;
* navigation: its words stand between menu separators, or it is one of a run of
  short lines without end marks (one by itself is a heading, and lines with a
  bullet or number are a list: both stay);
* boilerplate: stock phrases of web pages make up a good part of it (a sentence
  that mentions one stays).

Base measures of the whole text stand before that verdict; see measures().

Cases: null text counts as empty, fails the base and is not kept; a text without
words has zero everywhere; repeated rows are judged alike; an empty table gives
no rows.  Texts are never cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document is rejected if the lines that stay hold less than this share of its words.
MIN_KEPT_SHARE = 0.5
#: A line of fewer words without an end mark may be part of a menu; so many of them in a row are one.
SHORT_LINE = 4
MENU_LINES = 3
#: Stock phrases must hold this share of a line's words.
MIN_STOCK_SHARE = 1 / 3

# Marks, separators and stock phrases.
WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
END_MARKS = tuple(".!?…:;\"'”’»)]。！？")
_SEPARATORS = re.compile(r"[|»›·•→]|(?<=\s)[>/](?=\s)")
_LIST_ITEM = re.compile(r"\s*(?:[-*•–·]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s")
_STOCK = re.compile(
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie|copyright|©|\(c\) \d{4}|javascript"
    r"|click here|sign (?:in|up)|log ?in|subscribe|newsletter|share (?:this|on)|follow us|skip to|back to top"
    r"|read more|powered by|advertisement", re.IGNORECASE)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more.

    Windows are numbered exactly: of words, then of pairs, fours and eights, each
    as a pair of numbers of the level before.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    level = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    width = 1
    while width < window:
        level = level[:-width] * len(words) + level[width:]
        distinct, level, times = np.unique(level, return_inverse=True, return_counts=True)
        if len(distinct) == len(level):
            return 0
        width *= 2
    inside = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(times[level] > 1)
    inside[again] += 1
    inside[again + window] -= 1
    return int((np.cumsum(inside) > 0).sum())


def line_fails(line: str, words: list[str]) -> str | None:
    """The rule that a line with words fails, if any."""
    n = len(words)
    if n >= SHORT_LINE:
        shouted = sum(w.endswith(("!!", "??")) for w in words)
        marked = sum(w[-1] in SYMBOLS and w[0].isalnum() for w in words)
        if 3 * max(shouted, marked) > n or 2 * max(Counter(words).values()) > n:
            return "punctuation"
        if 10 * sum(a == b for a, b in zip(words, words[1:], strict=False)) > 3 * n:
            return "punctuation"
    separators = len(_SEPARATORS.findall(line))
    if separators >= 2 and (3 * separators >= n or n <= 6 * (separators + 1) and not line.rstrip().endswith(".")):
        return "navigation"
    if sum(len(found.split()) for found in _STOCK.findall(line)) >= MIN_STOCK_SHARE * n:
        return "boilerplate"
    return None


def menu_like(line: str, words: list[str]) -> bool:
    return len(words) < SHORT_LINE and not line.rstrip().endswith(END_MARKS) and not _LIST_ITEM.match(line)


def failures(lines: list[str]) -> list[str | None]:
    """For every line the rule it fails, if any; lines without words fail none."""
    split = [line.split() for line in lines]
    out = [line_fails(line, words) if words else None for line, words in zip(lines, split, strict=True)]
    run: list[int] = []
    for i, words in enumerate([*split, ["", "", "", "", "end"]]):
        if not words:  # blank lines do not end a menu
            continue
        if i < len(lines) and menu_like(lines[i], words):
            run.append(i)
            continue
        if len(run) >= MENU_LINES:
            for j in run:
                out[j] = out[j] or "navigation"
        run = []
    return out


def cleaned(text: str) -> tuple[str, int]:
    """The text without failing lines, and the words that stay.  Lines without words stay as they are."""
    lines = text.split("\n")
    kept = [line for line, rule in zip(lines, failures(lines), strict=True) if rule is None]
    return "\n".join(kept), sum(len(line.split()) for line in kept)


def measures(text: str) -> dict[str, int | bool]:
    """Base measures and both verdicts of one text."""
    return judged(text)[0]


def judged(text: str) -> tuple[dict[str, int | bool], str]:
    """measures() and the text without its failing lines (as it is, if the base fails)."""
    words = text.encode().split()  # bytes split at 09-0D and 20
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    repeats = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    clean, words_kept = (text, 0) if base_failed else cleaned(text)
    n_line_words = sum(len(line.split()) for line in lines)
    return {"n_words": len(words), "word_chars": len(text) - sum(map(text.count, WHITE)),
            "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": repeats, "base_failed": base_failed,
            "kept": not base_failed and words_kept >= MIN_KEPT_SHARE * n_line_words}, clean


_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean")
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tuple(measures(t).values()) for t in texts(batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
            names = [c.split()[0] for c in _SCHEMA.split(", ")]
            yield pa.record_batch({"doc_id": batch.column(0)} | {
                n: pa.array(c, kind) for n, c, kind in zip(names, columns, _TYPES, strict=True)})

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, f"doc_id long, {_SCHEMA}"))


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with failing lines removed from their text; other columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judged(t) for t in texts(batch.column(at))]
            stay = pa.array([v["kept"] for v, _ in verdicts], pa.bool_())
            clean = pa.array([t if v["kept"] else None for v, t in verdicts], pa.string())
            yield batch.set_column(at, "text", clean).filter(stay)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
