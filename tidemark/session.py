"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # what one execution shuffled goes when it ends, not when the driver next collects garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # a task that writes few folders, as records by day of expiry, holds them open and sorts nothing
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  memory: str = "12g", app: str = "tidemark", shared: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark.

    All executors of a local session are one process, so a temporary folder can
    stand in where neither ``shared`` nor the environment names a shared one.
    """
    named = SparkConf().get("spark.checkpoint.dir", None)
    shared = shared or named or tempfile.mkdtemp(prefix="tidemark-")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", memory)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", shared)
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("start the session with spark.checkpoint.dir set to a folder that all executors share")
    return base.rstrip("/")


_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder; inside scratch() it goes when that ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    held = _SCRATCH.get()
    if held is not None:
        held.append(path)
    return path


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """Written below the shared folder and read back: made once however often it is read, its size known."""
    path = path or fresh_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, path: str) -> tuple:
    """The Hadoop path and the file system it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = folder(spark, path)
    fs.delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what operators wrote in between for their own use, in threads that carry the context too.

    Results that still read it must have been written before.
    """
    held: list[str] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in held:
            remove(spark, path)
