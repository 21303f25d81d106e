"""The corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, source mixing, token shards.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of `documents`, and any others that docs have, as they are. Each stage handles nulls in any column, empty and very
long texts, ties, repeated rows, empty tables and clashing names as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackspark.llm import storage
from trackspark.llm.decontaminate import decontaminate
from trackspark.llm.importance_resample import resample
from trackspark.llm.jaccard_join import one_of_each
from trackspark.llm.queries import public_tokenizer
from trackspark.llm.source_mix import mixed_rows
from trackspark.llm.token_shards import read_shards, write_shards

#: The join of this stage takes word shingles of this many words, and links from this similarity in percent.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards those labelled good does not draw go."""
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one of smallest doc_id."""
    return one_of_each(docs, SHINGLE, PERCENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it: rows are repeated or go."""
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of all that is left, read back: doc_id, start, n_tokens, ids_crc32 of each written row."""
    return read_shards(write_shards(docs, public_tokenizer(), added=True))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("mixing sources to target weights", source_mix), ("token-ID / binary output", token_ids)]

#: Stages fit models and compare embeddings, which SQL cannot express; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = storage.table(docs, "stage")
    return docs
