"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import contextvars
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


#: Bytes of rows that Spark hands to a Python worker at a time; texts may be long, and rows alone bound nothing.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Set the size of the batches that go to Python workers."""
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("llm-scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what operators wrote in between for their own use.

    Frames that they returned still read it: write those inside, with keep=True.
    """
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in held:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path in the folder that the driver and all executors share; without keep it ends with scratch().

    The folder is the one the cluster names in spark.checkpoint.dir.  A session
    without it gets no default: a machine-local folder would be wrong there.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    path = os.path.join(folder, f"tidemark-{name}-{uuid.uuid4().hex}")
    held = _SCRATCH.get()
    if held is not None and not keep:
        held.append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of df, written once to the shared folder and read back.

    This cuts the lineage: later stages, retries included, read the files.
    """
    path = shared_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """Strings of an Arrow column one by one, null as empty."""
    for value in column:
        yield value.as_py() or ""


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of an Arrow string column one by one, null as empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


#: Rows of a range that is numbered in one task.
RANGE_ROWS = 1 << 17


def numbered(rows: DataFrame, group: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows with their place in their group, from 0, and the group's size; equal rows in any order.

    Rows are sorted into ranges of the whole order (group, order, row number), each
    range is counted, and what lies before is added: no group, and no copies of
    one row, meet in one task.  Null groups and null values come first.
    """
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = written(rows.repartitionByRange(ranges, *group, *order, "_row")
                    .withColumn("_range", F.spark_partition_id()), "ranges")
    names = [f"_g{i}" for i in range(len(group))]
    counts = dealt.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)],
                           F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = counts.select(
        *names, "_r", (F.sum("_n").over(Window.partitionBy(*names).orderBy("_r")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*names)).alias("group_size"))
    own = Window.partitionBy(*group, "_range").orderBy(*order, "_row")
    same = F.col("_range") == F.col("_r")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return (dealt.withColumn("_within", F.row_number().over(own) - 1).join(before, same)
            .withColumn("place", F.col("_before") + F.col("_within"))
            .drop("_row", "_range", "_r", "_within", "_before", *names))
