"""The pipeline over ``documents``: language, exact copies, near copies, personal data, packing.

Each stage gets all that its predecessor kept and, but for the last, returns the columns of its input. Between stages the
documents are written as Parquet to the shared folder and read again, so a stage is computed once.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import exact_dedup, language_id, near_dedup, packing, pii
from marginalia.scratch import written_once

TOKENIZER = "word_bpe_49k.json"

#: Words a Python worker remembers: fewer than packing alone would, as the workers served all stages before.
CACHED_WORDS = 300_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return language_id.accepted(docs, language_id.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near copies."""
    return near_dedup.kept(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without personal data and the terms that disclose it."""
    return pii.sanitised(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), cached_words=CACHED_WORDS)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("pii", personal_data),
    ("packing", pack),
]

#: Models, tokenizers and packing are beyond SQL; tests/llm/test_pipeline.py has the plain account.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
