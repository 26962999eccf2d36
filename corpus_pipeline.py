"""Corpus pipeline: stages over ``documents``, each one operator of curbcast.llm.

Every stage works on all rows that the one before it kept: unknown languages
go, one document of each near-duplicate class stays, documents that hold a test
item go, secrets are masked in the text, and what is left becomes token ids.
All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbcast.checkpoints import stage
from curbcast.llm import bpe, decontaminate, language, ngram_join, secrets


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects: no letters, or unlike every learned language."""
    return language.keep_known(docs, language.fit(docs))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate class."""
    return ngram_join.one_of_each(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item or an edited copy of one."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids of every text, and whether decoding them gives the text again."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_checked(docs, vocabulary, bpe.build_lexicon(docs, vocabulary))


STAGES = [("language", known_language), ("near_duplicates", one_of_each_class), ("decontamination", without_test_items), ("secrets", masked_secrets), ("token_ids", token_ids)]

# The stages learn models, align texts and run a tokeniser, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
