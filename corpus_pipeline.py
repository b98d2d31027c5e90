"""Corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact_dedup, language_id, packing, source_mixing, weighted_minhash
from tideline.llm.columns import crc_mod, table
from tideline.session import scratch_folder


def known_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language the model accepts; it learns from the labelled two thirds of op2."""
    return language_id.accepted(docs, language_id.train(docs, crc_mod("doc_id", 3) != 1))


def without_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return weighted_minhash.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document once, and those of smaller sources again, as far as the target weights ask for it."""
    return source_mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("minhash_neardup", without_near_copies),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: Language identification is a trained model: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``; the last stage's rows."""
    scratch = scratch_folder(spark, "corpus")
    docs = table(spark, folder, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{scratch}/{k}-{name}")
        docs = spark.read.parquet(f"{scratch}/{k}-{name}")
    return docs
