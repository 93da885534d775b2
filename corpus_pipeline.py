"""The corpus pipeline: five stages over documents, each on what its predecessor kept.

Every stage but the last returns the columns of its input, whatever they are called. Texts
that are null, empty or without a letter go in the first stage. Repeated rows leave one row
in the second, the one of the smallest identifier (nulls last); near copies leave one in the
third. Without benchmark items nothing is contaminated; without documents, or when none is
left, the result has no rows. A null identifier is kept like any other.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from twinloom.llm import decontamination, exact_dedup, language_id, ngram_join, packing
from twinloom.staging import checkpoint_root


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal texts."""
    return exact_dedup.keep_first(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language_id", identified),
    ("exact_dedup", unique),
    ("ngram_jaccard_join", distinct_enough),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: Language profiles, MinHash and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
