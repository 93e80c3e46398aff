"""Source against target: what is missing, extra or different, and its repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import key_origin

MATCH, MISSING, ORPHAN, MISMATCH, CLOUD_ROW = "MATCH", "MISSING", "ORPHAN", "MISMATCH", "CLOUD_ROW"
DRIFT_LIMIT_HOURS = 24


def compare(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key of either side: its class and a flag per differing column.

    Both sides are unique by key, so one shuffle on the key does it.  Extra
    rows with an odd key were born in the target and are no discrepancy.
    """
    s = source.select(F.col(key), F.struct(*columns).alias("src"))
    t = target.select(F.col(key), F.struct(*columns).alias("tgt"))
    both = s.join(t, key, "full_outer")
    paired = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    flags = {c: paired & ~F.col(f"src.{c}").eqNullSafe(F.col(f"tgt.{c}")) for c in columns}
    differs = F.lit(False)
    for f in flags.values():
        differs = differs | f
    extra = F.when(key_origin(F.col(key)) == "CLOUD", CLOUD_ROW).otherwise(ORPHAN)
    return both.select(
        key, "src", "tgt", *[f.alias(f"diff_{c}") for c, f in flags.items()],
        F.when(F.col("tgt").isNull(), MISSING).when(F.col("src").isNull(), extra)
        .when(differs, MISMATCH).otherwise(MATCH).alias("verdict"))


#: Parts of the key space that digests are made for; a difference costs the rows of its part.
DIGEST_PARTS = 65_536


def _digests(rows: DataFrame, key: str, columns: dict[str, str], parts: int) -> DataFrame:
    """Rows, exclusive or and sums of two row hashes for each part of the keys."""
    # as the wider of both sides' types; nulls leave a hash as it is, so they are told apart by a flag
    values = [F.coalesce(F.col(c), F.lit(None).cast(other)) for c, other in columns.items()]
    flagged = [x for v in values for x in (v, v.isNull())]
    one, two = F.xxhash64(*flagged), F.xxhash64(F.lit(1), *flagged)
    low = F.lit((1 << 32) - 1)
    return rows.groupBy(_part(key, parts).alias("part")).agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.bit_xor(one).alias("mixed"),
                 F.sum(two.bitwiseAND(low)).alias("low"), F.sum(F.shiftright(two, 32)).alias("high")).alias("digest"))


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts))


def differing_parts(source: DataFrame, target: DataFrame, key: str, columns: list[str],
                    parts: int = DIGEST_PARTS) -> DataFrame:
    """Parts of the key space whose rows are not the same on both sides: ``parts`` rows at most."""
    kinds = [{c: df.schema[c].dataType.simpleString() for c in (key, *columns)} for df in (source, target)]
    s = _digests(source, key, kinds[1], parts)
    t = _digests(target, key, kinds[0], parts).withColumnRenamed("digest", "other")
    return s.join(t, "part", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("other"))).select("part")


def compare_by_digest(source: DataFrame, target: DataFrame, key: str, columns: list[str],
                      parts: int = DIGEST_PARTS) -> DataFrame:
    """compare() without its MATCH rows, bringing together only the parts that differ.

    Each side is read once for its digests; no row of it is shuffled for that.
    The parts that differ are few rows by their number, so they are broadcast and
    each side is filtered where it lies before the rows meet.
    """
    apart = differing_parts(source, target, key, columns, parts).persist()
    sides = [df.withColumn("part", _part(key, parts)).join(F.broadcast(apart), "part", "left_semi").drop("part")
             if not apart.isEmpty() else df.limit(0) for df in (source, target)]
    return compare(*sides, key, columns).filter(F.col("verdict") != MATCH)


def discrepancies(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("verdict").isin(MISSING, ORPHAN, MISMATCH))


def missing(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return source.join(target.select(key), key, "left_anti")


def orphans(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    legacy = target.filter(key_origin(F.col(key)) == "LEGACY")
    return legacy.join(source.select(key), key, "left_anti")


def counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Row counts of source and target per table."""
    sides = []
    for name, pair in pairs.items():
        for side, df in zip(("source", "target"), pair):
            sides.append(df.agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n"))

    def count_of(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("n")))

    return (reduce(DataFrame.unionByName, sides).groupBy("table_name")
            .agg(count_of("source").alias("source_count"), count_of("target").alias("target_count"))
            .withColumn("gap", F.col("source_count") - F.col("target_count")))


def drift(found: DataFrame, key: str, modified: str, now: Column,
          limit_hours: int = DRIFT_LIMIT_HOURS) -> DataFrame:
    """Age of each discrepancy and whether it outlived the allowed window."""
    since = F.coalesce(F.col(f"src.{modified}"), F.col(f"tgt.{modified}"))
    age = now - since
    return found.select(key, "verdict", since.alias("since"),
                        (age > F.expr(f"make_dt_interval(0, {limit_hours}, 0, 0)")).alias("breach"))


def repair_feed(found: DataFrame, key: str, columns: list[str], modified: str) -> DataFrame:
    """Discrepancies as a change feed that heals the target when applied."""
    op = (F.when(F.col("verdict") == MISSING, "I").when(F.col("verdict") == ORPHAN, "D").otherwise("U"))
    row = F.coalesce("src", "tgt")
    return found.select(op.alias("op"), key, *[row[c].alias(c) for c in columns],
                        F.lit(None).cast("string").alias("datasync_flag"),
                        row[modified].alias("event_ts"))


def history_rows(found: DataFrame, table: str, key: str, run_id: str) -> DataFrame:
    """Every discrepancy of one comparison, under the number of its run."""
    return found.select(F.lit(run_id).alias("run_id"), F.lit(table).alias("table_name"), "verdict",
                        F.col(key).cast("string").alias("row_key"))


class DriftTable:
    """All discrepancies of all runs; a run owns its partition and writing it again replaces it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, history: DataFrame, run_id: str) -> DataFrame:
        """Store one run and return its rows as stored."""
        folder = f"{self.path}/run_id={run_id}"
        history.drop("run_id").write.mode("overwrite").parquet(folder)
        return self.spark.read.parquet(folder).withColumn("run_id", F.lit(run_id)).select(*history.columns)

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)


def alert_rows(history: DataFrame) -> DataFrame:
    """Per run, table and verdict the number of keys; the keys are in the drift table under that run."""
    return history.groupBy("run_id", "table_name", "verdict").agg(F.count(F.lit(1)).alias("row_count"))
