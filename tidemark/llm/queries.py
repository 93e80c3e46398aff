"""One query per operator of this folder, over whole tables with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    ann_forest, bpe_fst, chat_expand, html_crf, line_quality, merkle_versions, packing,
    pii_spans, piece_prefix, shard_tree, simhash_ball, token_blocks, word_runs)
from tidemark.llm.common import bounded, table

NEIGHBOURS = 10
END_ID = 2
SEQUENCE_TOKENS = 1024


Query = Callable[[SparkSession, str], DataFrame]


def query(build: Query) -> Query:
    @functools.wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded(spark)
        return build(spark, sf_dir)

    return run


@query
def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, NEIGHBOURS)


@query
def op2_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"  # control strings inside texts
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own)
    return chat_expand.read_back(chat_expand.formatted(chat_expand.expand(turns)))


@query
def op3_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.place(table(spark, sf_dir, "documents"), shard_tree.balanced(2, 2, 2))


@query
def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.written_and_read(table(spark, sf_dir, "documents"),
                                         public_tokenizers.path("word_bpe_49k.json"), END_ID)


@query
def op5_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


@query
def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


@query
def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ball.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.report(table(spark, sf_dir, "documents"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE_TOKENS)


@query
def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.round_trip(table(spark, sf_dir, "documents"),
                              public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op11_merkle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_versions.manifest(table(spark, sf_dir, "documents"))


@query
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.report(table(spark, sf_dir, "documents"))


@query
def op13_piece_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_prefix.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {build.__name__: build for build in (
    op1_prefix_forest, op2_prefix_target_chat, op3_shard_tree, op4_token_blocks,
    op5_html_crf, op6_line_quality, op7_simhash_ball, op8_pii_spans,
    op9_best_fit_packing, op10_bpe_transducer, op11_merkle_versions,
    op12_word_runs, op13_piece_prefix)}
