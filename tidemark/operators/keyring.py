"""Keys and tokens: allocation, keyrings, tokenisation, checks between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import key_origin, stable_uuid
from tidemark.session import fresh_path

#: Copies of a row made from one array.
REPEATS = 100_000


def assign_keys(rows: DataFrame, order: str, out: str, start: int, step: int = 2,
                tie: list[str] = ()) -> DataFrame:
    """Number new rows ``start, start+step, ...`` along ``order`` without gaps.

    The rows are dealt to ranges of (order, tie), as many as the cluster uses
    partitions, and written once with the number of their range.  Each range is
    then numbered by itself and shifted by the sizes of the ranges before.
    """
    path = fresh_path(rows.sparkSession, "numbering")
    rows.repartitionByRange(order, *tie).withColumn("_chunk", F.spark_partition_id()).write.parquet(path)
    cut = rows.sparkSession.read.parquet(path)
    inside = Window.partitionBy("_chunk").orderBy(order, *tie)
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"))
              .select("_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    return (cut.withColumn("_n", F.row_number().over(inside) - 1)
            .join(starts, "_chunk")
            .withColumn(out, (F.lit(start) + F.lit(step) * (F.col("_start") + F.col("_n"))).cast("bigint"))
            .drop("_chunk", "_n", "_start"))


def next_key(table: DataFrame, column: str, start: int, step: int = 2) -> int:
    """First unused key of a sequence that already reached ``max(column)``."""
    top = table.agg(F.max(column)).first()[0]
    return start if top is None else max(start, top + step)


def origin_report(table: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows per origin told by the key, and how many carry the other origin's flag."""
    origin = key_origin(F.col(key))
    from_flag = F.when(F.upper(flag) == "CLOUD", "CLOUD").otherwise("LEGACY")
    return (table.groupBy(origin.alias("origin"))
            .agg(F.count(F.lit(1)).alias("row_count"),
                 F.count_if(from_flag != origin).alias("flag_differs")))


def key_collisions(legacy_new: DataFrame, cloud_new: DataFrame, key: str) -> DataFrame:
    return legacy_new.select(key).join(cloud_new.select(key), key)


def missing_numbers(base: DataFrame, number: str, keyring: DataFrame | None, legacy: str,
                    order: str | None = None) -> DataFrame:
    """Business numbers that have no token yet, once each."""
    extra = [F.min(order).alias("_order")] if order else []
    grouped = base.filter(F.col(number).isNotNull()).groupBy(F.col(number).alias(legacy))
    wanted = grouped.agg(*extra) if extra else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return wanted if keyring is None else wanted.join(keyring.select(legacy), legacy, "left_anti")


def keyring_load(base: DataFrame, number: str, keyring: DataFrame | None, legacy: str,
                 uuid: str, order: str, start: int, salt: str = "", random: bool = False) -> DataFrame:
    """New keyring rows: one token per number, existing ones untouched.

    ``random`` draws fresh UUIDs: write such rows before using them twice.  The new
    numbers are planned once: assign_keys() reads what it has written.
    """
    fresh = missing_numbers(base, number, keyring, legacy, order)
    if keyring is not None:
        start = next_key(keyring, "keyring_id", start)
    numbered = assign_keys(fresh, "_order", "keyring_id", start, tie=[legacy])
    token = F.uuid() if random else stable_uuid(F.col(legacy), salt)
    return numbered.select("keyring_id", token.alias(uuid), legacy)


def tokenise(rows: DataFrame, number: str, keyring: DataFrame, legacy: str, uuid: str) -> DataFrame:
    """Replace the business number by its token."""
    ring = keyring.select(F.col(legacy).alias(number), uuid)
    return rows.join(ring, number).drop(number)


def detokenise(rows: DataFrame, uuid: str, keyring: DataFrame, legacy: str, number: str) -> DataFrame:
    ring = keyring.select(uuid, F.col(legacy).alias(number))
    return rows.join(ring, uuid).drop(uuid)


def keyring_gaps(base: DataFrame, number: str, keyring: DataFrame, legacy: str) -> DataFrame:
    """Numbers without token, once each, and every token without base row.

    Both sides are counted by number together: one shuffle and one hash table a task, no sort
    and no side held against the other.
    """
    numbers = base.select(F.col(number).alias("number"), F.lit(1).alias("_base"), F.lit(0).alias("_token"))
    tokens = keyring.select(F.col(legacy).alias("number"), F.lit(0).alias("_base"), F.lit(1).alias("_token"))
    seen = (numbers.unionByName(tokens).filter(F.col("number").isNotNull()).groupBy("number")
            .agg(F.max("_base").alias("_base"), F.sum("_token").alias("_tokens"))
            .filter((F.col("_base") == 0) | (F.col("_tokens") == 0)))
    # a token as often as it is there, in arrays of at most REPEATS
    parts = seen.select("number", "_tokens", F.explode(F.sequence(F.lit(0), F.col("_tokens"), F.lit(REPEATS))).alias("_from"))
    often = F.when(F.col("_tokens") == 0, 1).otherwise(F.least(F.lit(REPEATS), F.col("_tokens") - F.col("_from")))
    gaps = parts.select("number", F.when(F.col("_tokens") == 0, "NO_TOKEN").otherwise("NO_BASE_ROW").alias("gap"),
                        F.explode(F.array_repeat(F.lit(1), often.cast("int")))).drop("col")
    unnamed = tokens.filter(F.col("number").isNull()).select("number", F.lit("NO_BASE_ROW").alias("gap"))
    return gaps.unionByName(unnamed)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts side by side."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
