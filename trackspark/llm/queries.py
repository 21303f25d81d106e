"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_compression, exact_dedup, source_mix


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance_resample import importance_scores

    return importance_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import read_shards, write_shards

    return read_shards(write_shards(_documents(spark, sf_dir), public_tokenizer(), added=True))


def op1_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_fingerprint import edited_fingerprints

    return edited_fingerprints(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_documents(spark, sf_dir))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix_sources

    return mix_sources(_documents(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .code_compression import compressed_codes

    return compressed_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import run_report

    return run_report(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chunk_fingerprint": op1_chunk_fingerprint,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_html_extract": op5_html_extract,
    "op6_decontaminate": op6_decontaminate,
    "op7_license_scan": op7_license_scan,
    "op8_source_mix": op8_source_mix,
    "op9_importance_resample": op9_importance_resample,
    "op10_token_shards": op10_token_shards,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op8_source_mix": source_mix.SQL,
    "op11_exact_dedup": exact_dedup.SQL,
    "op12_vector_codes": code_compression.SQL,
}
