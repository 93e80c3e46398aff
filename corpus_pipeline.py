"""From documents to packed training sequences, stage by stage.

Each stage works on all rows its predecessor kept and calls one operator:

1. quality: lines that fail a rule go, documents that fail or lose too much go
2. near_duplicates: of every group of near copies one row stays, that with the smallest id
3. personal_data: confirmed spans are replaced by their kind
4. packing: every document's tokens get places in sequences

All but the last return the columns of documents, with n_chars of the text as it
is now.  A null id comes after all others; of rows with the same id one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_quality, packing, pii_spans, simhash_ball
from tidemark.llm.common import bounded, remove, scratch, shared_path, table, written
from tidemark.llm.queries import END_ID, SEQUENCE_TOKENS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return _recounted(line_quality.keep_clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    row = "_row"
    while row in docs.columns:  # a name that no column of the input has
        row += "_"
    # written, so that a row has the same number whenever it is read
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    return rows.join(simhash_ball.first_rows(rows, row), row, "left_semi").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii_spans.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Hashes, checksums with positions and tokenizers are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next.

    What a stage wrote for its own use goes when its rows are written, and these go
    when the next stage has written its own: only the last ones stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            path = shared_path(spark, name, keep=True)
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
