"""Initial load of whole tables, and the gate behind it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.store import KeyedTable


class EmptyTableError(RuntimeError):
    pass


def initial_load(tables: list[tuple[DataFrame, KeyedTable]], batch_id: int = 0) -> None:
    """Write snapshots in the order given (parents first).

    Each lands as one batch of its keyed table, so a repeated load replaces
    its own batch and nothing else.
    """
    for snapshot, target in tables:
        target.write_batch(snapshot, batch_id)


def load_gate(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and verdict per loaded table."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    return (reduce(DataFrame.unionByName, counts)
            .withColumn("is_loaded", F.col("row_count") > 0))


def require_rows(tables: dict[str, DataFrame]) -> None:
    """Stop when a table that should have been loaded holds no row."""
    empty = [name for name, df in tables.items() if df.limit(1).isEmpty()]
    if empty:
        raise EmptyTableError(f"no rows in {', '.join(empty)}: run the initial load first")
