"""A training-data pipeline of five stages over ``documents``.

Each stage takes all that the one before kept; its result is written as Parquet to the shared folder and read again.
The first four return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespring.llm import mixing, ngram_join, packing, pii, quality
from lorespring.llm.common import table, written
from lorespring.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return ngram_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms masked."""
    return pii.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in training order."""
    return mixing.apply_mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of 2048 tokens."""
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1, ranks_path=ranks)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", source_mix),
    ("packing", sequence_packing),
]

#: Neither the tokenizer nor the components of all links of a text corpus are within SQL: tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
