"""Change files: pipe-separated lines, one committed transaction after another.

A data line is ``op | table | schema | event_ts | data columns ...``; the first
and last line of a transaction are markers.  Files are read line by line, never
as one row per file, so one file may hold any share of the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.conversions import strip
from tidemark.session import kept

# Marker letters and the positions of the four header fields.
MARKERS = ("B", "C")
HEADER_FIELDS = 4
MIN_FIELDS = 5

BLANK, MARKER, SHORT, OPEN_QUOTE, DATA = "BLANK", "MARKER", "SHORT", "OPEN_QUOTE", "DATA"

# Possessive groups: the matcher loops over them, while a plain group would recurse once per character.
_QUOTED = r'"(?:[^"]++|"")*+"'
_FIELD = rf'\|({_QUOTED}[^|]*+|[^|]*+)'
_OPEN_FIELD = rf'^(?:(?:{_QUOTED}[^|]*+|[^"|][^|]*+|)\|)*+"(?:[^"]++|"")*+$'


def _unquote(field: Column) -> Column:
    inner = F.regexp_replace(field, r'^"((?:[^"]++|"")*+)"', "$1")
    return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)


def split_fields(line: Column) -> Column:
    """Fields of one line; only lines that hold a quote take the slow pattern."""
    # with a delimiter in front every field is "delimiter, then text"
    fields = F.regexp_extract_all(F.concat(F.lit("|"), line), F.lit(_FIELD), F.lit(1))
    quoted = F.transform(fields, _unquote)
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, r"\|", -1))


def read_lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Lines of all change files below ``path`` with their order inside the file.

    ``line_pos`` sorts the lines of a file: split start, then position inside
    the split.  ``numbered`` adds dense line numbers (from 1), which costs one
    more pass to count the lines of each split.
    """
    raw = (spark.read.option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.[cC][sS][vV]").text(path))
    lines = raw.select(
        F.col("_metadata.file_path").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"),
        F.make_valid_utf8(F.col("value")).alias("line"))
    if not numbered:
        return lines.select("file_name", F.struct("block", "mid").alias("line_pos"), "line")
    before = (Window.partitionBy("file_name").orderBy("block")
              .rowsBetween(Window.unboundedPreceding, -1))
    # written and read back: its size is known then, so the lines need not be dealt out to meet it
    starts = kept(lines.groupBy("file_name", "block")
              .agg(F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n"))
              .select("file_name", "block", "first_mid",
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped")))
    return (lines.join(starts, ["file_name", "block"])
            .select("file_name", F.struct("block", "mid").alias("line_pos"),
                    (F.col("skipped") + F.col("mid") - F.col("first_mid") + 1).alias("line_num"),
                    "line"))


def classify(lines: DataFrame) -> DataFrame:
    """Add the field array and the kind of each line.

    The one-element explode keeps the split where it is: later filters and
    projections read its result instead of repeating it per column.
    """
    fields = lines.select("*", F.explode(F.array(split_fields(F.col("line")))).alias("cols"))
    first = F.upper(strip(F.col("cols")[0]))
    return fields.withColumn(
        "kind",
        F.when(F.col("line") == "", BLANK)
        .when(first.isin(*MARKERS), MARKER)
        .when(F.col("line").contains('"') & F.col("line").rlike(_OPEN_FIELD), OPEN_QUOTE)
        .when(F.size("cols") < MIN_FIELDS, SHORT)
        .otherwise(DATA))


def _parsed() -> list[Column]:
    """The normalised header and the other fields of a line."""
    cols = F.col("cols")
    at = [strip(F.get(cols, F.lit(i))) for i in range(HEADER_FIELDS)]
    return [F.upper(at[0]).alias("op"), F.lower(at[1]).alias("src_table"), F.lower(at[2]).alias("src_schema"),
            at[3].alias("event_ts"),
            F.slice(cols, HEADER_FIELDS + 1, F.greatest(F.size(cols) - HEADER_FIELDS, F.lit(0))).alias("data")]


def data_rows(classified: DataFrame, raw: bool = False) -> DataFrame:
    """Data lines with a normalised header; ``data`` holds the other fields, ``line`` (raw) the line as read."""
    keep = [c for c in classified.columns if c not in ("cols", "kind") and (raw or c != "line")]
    return classified.filter(F.col("kind") == DATA).select(*keep, *_parsed())


def rejected_rows(classified: DataFrame) -> DataFrame:
    """Lines that cannot be read as data, with the reason; nothing is lost."""
    keep = [c for c in classified.columns if c not in ("cols", "kind")]
    return classified.filter(F.col("kind").isin(SHORT, OPEN_QUOTE)).select(
        *keep, F.size("cols").alias("n_cols"),
        F.concat(F.col("kind"), F.lit("_ROW")).alias("reason"))


def read_once(lines: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """data_rows(raw) and rejected_rows() of lines that are split once: ``keep`` writes both kinds and reads them back."""
    both = classify(lines).filter(F.col("kind").isin(DATA, SHORT, OPEN_QUOTE))
    both = keep(both.select(*lines.columns, "kind", F.size("cols").alias("n_cols"), *_parsed()))
    reason = F.concat(F.col("kind"), F.lit("_ROW")).alias("reason")
    return (both.filter(F.col("kind") == DATA).drop("kind", "n_cols"),
            both.filter(F.col("kind") != DATA).select(*lines.columns, "n_cols", reason))


def parse(lines: DataFrame) -> DataFrame:
    return data_rows(classify(lines))


def read_cdc(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    return parse(read_lines(spark, path, numbered))
