"""A training corpus made from ``documents`` in five stages.

Each stage takes all that its predecessor kept and is written as Parquet before the next one reads it.
Stages choose documents or change texts and hand on the columns of ``documents``; the last adds how
many words of each document the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.llm import decontaminate, langid, minhash, mix, secrets
from provloom.llm.common import scratch, table
from provloom.llm.queries import held_out


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the labelled languages (no letters, or rejected by all models)."""
    labelled = held_out(docs.select("doc_id", "lang", "text")).where("not held_out")
    found = langid.identify_language(docs, langid.train(labelled), keep=docs.columns)
    return found.where("not rejected").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8): that of the smallest id, then digest of the text.

    A row is known by its id and text, as ids can be null or stand for several texts.
    """
    ids = minhash.kept_rows(docs).select(F.col("id").alias("_id"), F.col("digest").alias("_of"), "repeated")
    repeats = ids.where("repeated")
    rows = docs.withColumn("_digest", minhash.text_digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of"))
    # Merged at every size: ids grow with the corpus and aren't broadcast.
    once = rows.join(ids.where("not repeated").hint("merge"), same, "left_semi").select(docs.columns)
    if repeats.isEmpty():
        return once
    # Rows that repeat an id and its text: the smallest of each by the other columns.
    smallest = rows.join(repeats, same, "left_semi").groupBy("doc_id", "_digest").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.unionByName(smallest.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.where("not contaminated").select(docs.columns)


def take_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; every document stays."""
    found = secrets.scan_secrets(docs, keep=docs.columns)
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("redacted")).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with how many it takes."""
    return mix.mix_sources(docs, weights=[3, 1, 2], keep=docs.columns).where("taken > 0")


STAGES = [
    ("language_id", identify_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", take_out_secrets),
    ("source_mix", mix_to_weights),
]

#: Language models, sketches and lexing are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Empty tables and nulls are treated as the stages' operators say.

    What a stage writes for itself is deleted when the stage is written, and all but the last stage
    at the end.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as last:
        for name, stage in STAGES:
            with scratch(spark) as keep:
                written = last if name == STAGES[-1][0] else keep
                docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
