"""The queries opN_<name>: each applies its operator to the whole of its table and digests what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, minhash, mix, oracles, secrets, substring, suffix, tokens, vectors
from .common import table


def held_out(df: DataFrame) -> DataFrame:
    """Adds held_out: crc32 of the id as text is 1 modulo 3 (never for a null id)."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.dedup_suffixes(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(table(spark, sf_dir, "documents"))
    found = langid.identify_language(docs, langid.train(docs.where("not held_out")), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(table(spark, sf_dir, "documents"), weights=[3, 1, 2])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup_substrings(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_language_id, op3_license_scans, op4_benchmark_decontamination, op5_source_mix, op6_substring_dedup, op7_token_counts, op8_minhash_near_dedup, op9_secret_scans, op10_embedding_near_dedup)}


def oracle_sql() -> dict[str, str]:
    """Language models, a tokenizer's merges and propagated constants are beyond SQL: those three are held
    against held-out labels, the tokenizer's own library and a brute-force version in tests."""
    return dict(oracles.SQL)
