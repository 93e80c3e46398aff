"""Personal data in texts: regular expressions propose spans, validators confirm, context adjusts.

Everything is a Spark expression.  A text is split by a kind's pattern and the
matches are extracted by the same pattern; both walk the text once, from left to
right, and the lengths of pieces and matches give the spans in code points.

Patterns are written so that the matcher neither recurses nor starts again inside
a run of characters it has already seen: groups are possessive, and a match may
only begin where a run begins or where the last match ended.  The matches are
those of the plain pattern beside them.

Base kinds (email, ip, card, phone) are kept if their validator passes.  Added
kinds are kept if their score reaches MIN_SCORE: a proposal has its kind's score,
a passed checksum and a context word within CONTEXT characters add to it.

An account code may be followed by words that could belong to it, so its match is
a proposal at every place where a code may begin, and the longest part of it that
ends at the end of a group and passes mod-97 is the code.

Cases: null or empty text has no spans (the digest is that of the empty string);
overlapping spans of different kinds are all reported; repeated rows are
separate; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.65
CONTEXT = 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    number = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(F.expr("array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)")[c.cast("int")]))
    return F.aggregate(number, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code passes the mod-97 check: its first four characters go last, A is 10."""
    bare = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        return F.when(char.between("0", "9"), (rest * 10 + char.cast("int")) % 97).otherwise(
            (rest * 100 + F.ascii(char) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _code(match: Column) -> Column:
    """The longest part, whole groups of a shape that a code can have, that passes mod-97; else the whole match."""
    groups = F.split(match, " ")
    parts = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)),
                        lambda n: F.array_join(F.slice(groups, 1, n), " "))
    passed = F.filter(parts, lambda p: (F.length(F.replace(p, F.lit(" "), F.lit(""))) >= 15) & mod97(p))
    return F.coalesce(F.get(passed, F.lit(0)), match)


def _valid_ip(match: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(match, r"\."),
                    lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))


def _valid_card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def _valid_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    needs: str  # a quick test that any text with a match passes
    score: float = 1.0
    checked: float = 0.0  # what a passed validator adds
    words: tuple[str, ...] = ()
    part: Callable[[Column], Column] | None = None  # what of a match is the proposal (with step)
    step: int | None = None  # characters the pattern takes; the match is then its group 1, which looks ahead


# The base patterns as the contract states them (comment), and as they are run.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _valid_ip, r"[0-9]\.[0-9]"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _valid_card, "[0-9]"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _valid_phone, r"\+[0-9]"),
)
ADDED = (
    # [A-Z]{2}[0-9]{2}([\x20]?[A-Z0-9]){11,30} between characters that are no letters or digits, wherever one begins
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])))[A-Z]{2}[0-9]{2}",
         mod97, "[A-Z][0-9][0-9]", score=0.3, checked=0.4,
         words=("iban", "account", "konto", "compte", "cuenta", "bank"), part=_code, step=4),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(False),
         "[0-9]-[0-9][0-9]-[0-9]", score=0.4, words=("ssn", "social security", "tax", "taxpayer")),
)
KINDS = BASE + ADDED


def _score(kind: Kind, text: Column, match: Column, start: Column) -> Column:
    first = F.greatest(start - CONTEXT, F.lit(0))
    around = F.lower(F.substr(text, first + 1, start - first + F.length(match) + CONTEXT))
    named = F.lit(False)
    for word in kind.words:
        named |= F.contains(around, F.lit(word))
    return (F.lit(kind.score) + F.when(kind.valid(match), kind.checked).otherwise(0.0)
            + F.when(named, 0.3).otherwise(0.0))


def _kept(kind: Kind, text: Column, match: Column, start: Column) -> Column:
    return kind.valid(match) if kind in BASE else _score(kind, text, match, start) >= MIN_SCORE


def _parts(kind: Kind, text: Column) -> Column:
    """Pieces between matches, each with the match after it (null after the last)."""
    return F.arrays_zip(F.split(text, kind.pattern, -1).alias("piece"),
                        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.step else 0)).alias("match"))


def _taken(kind: Kind, match: Column) -> Column:
    """Characters from a match's start to the next piece (null without match)."""
    return F.when(match.isNotNull(), F.lit(kind.step)) if kind.step else F.length(match)


_BLOCK = 256
_SPAN = "struct<start: int, kind: int, end: int>"


def _step(number: int, text: Column) -> Callable[[Column, Column], Column]:
    """Walk on over one piece and its match; at is where the walk stands."""
    kind = KINDS[number]

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        added = lambda match: F.when(
            match.isNotNull() & _kept(kind, text, match, start),
            F.concat(state["spans"], F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"),
                                                      (start + F.length(match)).alias("end"))))).otherwise(state["spans"])
        match = part["match"]
        return F.struct((start + F.coalesce(_taken(kind, match), F.lit(0))).alias("at"),
                        (_bound(kind.part(match), added) if kind.step else added(match)).alias("spans"))

    return step


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _walk(number: int, text: Column) -> Callable[[Column], Column]:
    """Spans of all parts, block by block: an array that grows entry by entry is copied each time."""

    def walk(parts: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.size(parts) - 1, F.lit(_BLOCK))
        block = lambda i: F.slice(parts, i + 1, F.lit(_BLOCK))
        size = lambda p: F.length(p["piece"]) + F.coalesce(_taken(KINDS[number], p["match"]), F.lit(0))
        sizes = F.transform(blocks, lambda i: F.aggregate(block(i), F.lit(0), lambda at, p: at + size(p)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        none = F.array().cast(f"array<{_SPAN}>")
        return _bound(starts, lambda starts: F.flatten(F.transform(blocks, lambda i, k: F.aggregate(
            block(i), F.struct(F.get(starts, k).alias("at"), none.alias("spans")), _step(number, text),
            lambda state: state["spans"]))))

    return walk


def spans(text: Column) -> Column:
    """array<start, kind (its place in KINDS), end> in order of start, then kind."""
    none = F.array().cast(f"array<{_SPAN}>")
    found = [F.when(F.rlike(text, F.lit(kind.needs)), _bound(_parts(kind, text), _walk(number, text))).otherwise(none)
             for number, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def find(docs: DataFrame) -> DataFrame:
    """The rows with text as a string (null: empty) and their `found` spans."""
    return (docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
            .withColumn("found", spans(F.col("text"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of spans of every base kind, digest of the base spans, all spans."""
    found = find(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "found")
    names = F.array(*[F.lit(k.name) for k in KINDS])
    listed = lambda s: F.array_join(F.transform(
        s, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] < len(BASE))
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{k.name}")
              for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("found")).alias("spans"))


def _rewritten(text: Column, found: Column) -> Column:
    """The text with every stretch of overlapping spans replaced by the kind of its first span.

    Block by block: what a block needs of the text is cut from it once.  `at` is how
    far the text is done, the largest end so far.
    """
    marks = F.array(*[F.lit(f"<{k.name.upper()}>") for k in KINDS])
    length = F.length(text)
    starts = F.sequence(F.lit(0), F.size(found) - 1, F.lit(_BLOCK))
    block = lambda i: F.slice(found, i + 1, F.lit(_BLOCK))
    done = F.aggregate(starts, F.array(F.lit(0)), lambda ends, i: F.concat(ends, F.array(
        F.greatest(F.element_at(ends, -1), F.array_max(F.transform(block(i), lambda x: x["end"]))))))

    def pieces(spans: Column, first: Column, last: Column) -> Column:
        """The text from first to last, in which all spans of a block begin."""
        def step(part: Column) -> Callable[[Column, Column], Column]:
            return lambda state, x: F.struct(
                F.greatest(state["at"], x["end"]).alias("at"),
                F.when(x["start"] >= state["at"], F.concat(state["out"], F.array(
                    F.substr(part, state["at"] - first + 1, x["start"] - state["at"]), F.get(marks, x["kind"]))))
                .otherwise(state["out"]).alias("out"))

        none = F.array().cast("array<string>")
        whole = lambda part: F.aggregate(
            spans, F.struct(first.alias("at"), none.alias("out")), step(part), lambda state: F.concat(
                state["out"], F.array(F.substr(part, state["at"] - first + 1, F.greatest(last - state["at"], F.lit(0))))))
        return _bound(F.substr(text, first + 1, F.greatest(last - first, F.lit(0))), whole)

    # a block's text reaches to where the next one's first span begins
    begin = lambda i: F.get(found, i)["start"]
    return _bound(done, lambda done: F.array_join(F.flatten(F.transform(starts, lambda i, k: pieces(
        block(i), F.when(i > 0, F.greatest(F.get(done, k), begin(i))).otherwise(F.lit(0)),
        F.coalesce(begin(i + _BLOCK), length)))), ""))


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span of text that report() names replaced by its kind in angle brackets.

    The spans are those of the text as it comes in.  Overlapping ones are replaced
    together, by the kind of the first.  Null stays null.
    """
    text = F.col("text")
    return docs.withColumn("text", text.cast("string")).withColumn("text", _bound(
        spans(text), lambda found: F.when(F.size(found) > 0, _rewritten(text, found)).otherwise(text)))
