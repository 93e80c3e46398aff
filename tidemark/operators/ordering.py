"""Order inside a file: parents before children, commit order otherwise kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.metadata import UNKNOWN_RANK

PIECE_LINES = 100_000


def with_rank(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Dependency rank of each row's table; unknown tables go last."""
    return (rows.join(ranks, ["src_schema", "src_table"], "left")
            .withColumn("dep_rank", F.coalesce("dep_rank", F.lit(UNKNOWN_RANK))))


def fk_order(ranked: DataFrame, piece: int = PIECE_LINES,
             keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Place of each row after the stable parent-first sort of its file.

    Numbering runs inside (file, rank, piece of lines), and one count per such
    group shifts it, so a file that holds most of the data is numbered by many
    tasks.  ``keep`` writes the rows, which both read: rows that are costly to make
    are then made once.
    """
    pieces = (keep(ranked) if keep else ranked).withColumn("_piece", F.floor(F.col("line_num") / piece))
    group = ["file_name", "dep_rank", "_piece"]
    inside = Window.partitionBy(*group).orderBy("line_num")
    before = (Window.partitionBy("file_name").orderBy("dep_rank", "_piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
              .select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    return (pieces.withColumn("_n", F.row_number().over(inside))
            .join(starts, group)
            .withColumn("position", (F.col("_start") + F.col("_n")).cast("bigint"))
            .drop("_piece", "_n", "_start"))


def reordered_files(ranked: DataFrame, piece: int = PIECE_LINES) -> DataFrame:
    """Per file: does the parent-first sort change its order?

    Only neighbours are compared, inside pieces and across their seams.
    """
    pieces = ranked.withColumn("_piece", F.floor(F.col("line_num") / piece))
    inside = Window.partitionBy("file_name", "_piece").orderBy("line_num")
    seam = Window.partitionBy("file_name").orderBy("_piece")
    falls = F.coalesce(F.lag("dep_rank").over(inside) > F.col("dep_rank"), F.lit(False))
    ends = (pieces.withColumn("_falls", falls).groupBy("file_name", "_piece")
            .agg(F.bool_or("_falls").alias("_falls"),
                 F.min_by("dep_rank", "line_num").alias("_head"),
                 F.max_by("dep_rank", "line_num").alias("_foot")))
    across = F.coalesce(F.lag("_foot").over(seam) > F.col("_head"), F.lit(False))
    return (ends.withColumn("_falls", F.col("_falls") | across)
            .groupBy("file_name").agg(F.bool_or("_falls").alias("reordered")))


def file_summary(rows: DataFrame) -> DataFrame:
    """Rows and tables per file; counted per table first."""
    per_table = (rows.groupBy("file_name", "src_schema", "src_table")
                 .agg(F.count(F.lit(1)).alias("n")))
    named = F.when((F.col("src_schema") != "") & (F.col("src_table") != ""),
                   F.concat_ws(".", "src_schema", "src_table"))
    return (per_table.withColumn("_t", named).groupBy("file_name")
            .agg(F.sum("n").alias("total_rows"),
                 F.sort_array(F.collect_set("_t")).alias("tables_seen")))
