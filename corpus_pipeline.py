"""A corpus pipeline: language identification, exact dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its rows are written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import chunk_dedup, langid, mixing, ngram_join, packing
from feedloom.llm.common import fold
from feedloom.llm.queries import mix_settings
from feedloom.session import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that can be told, go."""
    return langid.keep_identified(docs, may_learn=fold("doc_id", 4) != 2)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return chunk_dedup.keep_first_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a similarity of 0.8 over five words, the one with the least id stays."""
    return ngram_join.keep_one(docs, n=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of a stated size, whose expected tokens have the target shares of sources, languages and topics as far as
    these have the tokens."""
    return mixing.sample(docs, **mix_settings())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Languages are told by a trained classifier, which SQL cannot express; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
