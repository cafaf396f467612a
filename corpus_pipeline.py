"""A training-corpus pipeline over ``documents``: each stage's result is written and read again as the next one's input.

language: documents without a recognised language go. near_duplicates: one document of each group of near
copies stays (wide fingerprints of five-word shingles, similarity 0.8 or more). secrets: every document stays, secret spans are masked. mix: documents
are taken, repeated or left out to meet the sources' targets. tokens: token ids of each document, with digests of ids and decoded text.

Defined results: null and empty texts have no language and go; very long texts are single rows of tasks; of rows that are repeated whole one stays, and rows without a
doc_id are no one's copies; a null source is a source of its own; an empty table gives an empty result; columns of other names pass through all
stages, and the last one's columns replace those of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from consensa.functions.session import prepare
from consensa.functions.tables import scope
from consensa.llm import bpe, language_id, near_copies, secret_scan, source_mix
from consensa.llm.common import durable, release


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_copies.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return source_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.encoded(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: Language scores and random-run tests have no SQL form; each stage is tested against a brute-force version or the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage read and made on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last = docs
        with scope(spark) as own:
            docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
            own.spare(docs)
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
