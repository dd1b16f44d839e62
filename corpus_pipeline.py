"""A corpus pipeline of five stages: quality, near duplicates, benchmark leaks, source mix, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, mixing, near_dedup, quality, token_files
from graphloom.llm.common import spool, table
from graphloom.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.keep_sampled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id; of rows that repeat its id, one."""
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times."""
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_digests(docs, vocabulary(token_files.VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_files", write_token_files),
]

#: SQL can't express the learned stages and the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
