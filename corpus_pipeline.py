"""Documents to packed sequences: language ID, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hangarlog.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from hangarlog.llm.frames import stash, table
from hangarlog.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts in no language (null, or without a letter) go."""
    return language_id.keep_identified(docs, language_id.learn_profiles(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the one with the largest identifier stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each source to its target: documents are repeated or left out."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("ngram_jaccard", drop_near_copies),
          ("mixing", mix), ("packing", pack)]

#: Rounding and packing draw on hashes and on the order of rows, which SQL cannot restate; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
