"""Hot keys: find them cheaply, split their work, keep results exact.

Nothing here changes a result.  A profile only says which keys are heavy, and
whichever keys it names, the operators that use it return the same rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import fresh_path

TASK_ROWS = 1_000_000
#: Sampled rows by which a key of TASK_ROWS rows is known; a fixed number, whatever the input holds.
SAMPLED_ROWS = 1000


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


@dataclass(frozen=True)
class KeyProfile:
    """Keys (by hash) that hold more rows than one task should, and the rows of all of them, estimated."""

    keys: tuple[str, ...]
    task_rows: int
    hot: DataFrame | None = None
    hot_rows: int = 0

    def pieces(self) -> int:
        """Pieces of ``task_rows`` rows; of less than TASK_ROWS only as many as a shuffle has partitions.

        A piece is a task and a file, so pieces of a few rows would cost more than the rows in them.
        """
        wanted = math.ceil(self.hot_rows / self.task_rows)
        if self.hot is None:
            return max(2, wanted)
        enough = int(self.hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(2, min(wanted, max(enough, math.ceil(self.hot_rows / TASK_ROWS))))

    def heavy(self, df: DataFrame) -> DataFrame:
        return self._marked(df).filter(F.col("_hot").isNotNull()).drop("_h", "_hot")

    def light(self, df: DataFrame) -> DataFrame:
        return self._marked(df).filter(F.col("_hot").isNull()).drop("_h", "_hot")

    def _marked(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_h", key_hash(list(self.keys))).join(
            self.hot.withColumn("_hot", F.lit(True)), "_h", "left")


def no_hot_keys(keys: list[str], task_rows: int = TASK_ROWS) -> KeyProfile:
    """The profile of rows too few for any key to be hot."""
    return KeyProfile(tuple(keys), task_rows)


def sample_rate(task_rows: int = TASK_ROWS) -> float:
    """The share of rows that shows a key of ``task_rows`` rows."""
    return min(1.0, SAMPLED_ROWS / task_rows)


def profile_keys(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS, drawn: bool = False) -> KeyProfile:
    """Hot keys by counts over a sample of the key columns.

    The sample is as thin as a key at the limit allows, so it costs one scan of
    the key columns and a shuffle of a thousandth of their rows.  Where rows are
    costly to make, draw from what they are made of at sample_rate() and pass the
    few rows made of that (``drawn``).  The hot keys stay a table: their number
    grows with the input.  It is written and read back, so every later use of them
    agrees even when a sample drawn again from recomputed rows would not.
    """
    rate = sample_rate(task_rows)
    sample = df.select(key_hash(keys).alias("_h"))
    sample = sample if drawn or rate == 1.0 else sample.sample(rate, seed=17)
    hot = sample.groupBy("_h").count().filter(F.col("count") > rate * task_rows).persist()
    rows = hot.agg(F.sum("count")).first()[0]
    if not rows:
        hot.unpersist()
        return no_hot_keys(keys, task_rows)
    path = fresh_path(df.sparkSession, "hot-keys")
    hot.select("_h").write.parquet(path)
    hot.unpersist()
    return KeyProfile(tuple(keys), task_rows, df.sparkSession.read.schema("_h long").parquet(path),
                      math.ceil(rows / rate))


def range_pieces(df: DataFrame, order: list, pieces: int, out: str = "_chunk") -> DataFrame:
    """Rows in ``pieces`` of about equal size along the whole order, the piece's number beside them.

    Ranges of all order columns together: rows that share a time are parted by
    what comes after it.  The rows are written, so that whatever reads them again
    sees the same pieces; no cut point reaches the driver or the plan.
    """
    path = fresh_path(df.sparkSession, "pieces")
    (df.repartitionByRange(pieces, *order).withColumn(out, F.spark_partition_id())
     .write.parquet(path))
    return df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())])).parquet(path)


def prior_max(df: DataFrame, keys: list[str], order: list, reset: Column, value: Column,
              out: str, chunk: str | None = None) -> DataFrame:
    """Largest ``value`` before each row, counted from the last ``reset`` on.

    Per key in ``order``; a reset row opens a new stretch that it belongs to,
    and sees nothing before itself.  Pairing the stretch number with the value
    makes the running maximum do both jobs under one sort.

    With ``chunk`` (a column that grows along the order) a key's rows are
    handled piece by piece in separate tasks, and one summary row per piece
    carries the open stretch into the next.
    """
    part = [*keys, chunk] if chunk else list(keys)
    window = Window.partitionBy(*part).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    marked = (df.select("*", value.alias("_value"), F.sum(reset.cast("long")).over(upto).alias("_stretch"))
              .select("*", F.max(F.struct("_stretch", "_value")).over(before).alias("_best")))
    local = F.when(F.col("_best._stretch") == F.col("_stretch"), F.col("_best._value"))
    if not chunk:
        return marked.select(*df.columns, local.alias(out))

    along = Window.partitionBy(*keys).orderBy(chunk)
    run = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (marked.groupBy(*part)
             .agg(F.max("_stretch").alias("_resets"),
                  F.max(F.struct("_stretch", "_value"))["_value"].alias("_tail"))
             .withColumn("_opened", F.sum((F.col("_resets") > 0).cast("long")).over(run))
             .withColumn("_open", F.max(F.struct("_opened", "_tail")).over(run)["_tail"])
             .select(*part, F.lag("_open").over(along).alias("_carry")))
    whole = F.when(F.col("_stretch") == 0, F.greatest(local, "_carry")).otherwise(local)
    return marked.join(carry, part, "left").select(*df.columns, whole.alias(out))
