"""From raw documents to token ids: one stage an operator, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from torqueline.llm import byte_bpe, decontamination, language_id, near_dedup, personal_data
from torqueline.llm.entry import multilingual_codec, table
from torqueline.llm.runtime import write_table

#: Shingles of the near-duplicate stage, in words, and the least similarity in percent.
WORDS, SHARE = 5, 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay."""
    return language_id.in_a_language(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dedup.one_of_each(docs, WORDS, SHARE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return personal_data.redacted(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids take the place of texts."""
    return byte_bpe.encoded(docs, multilingual_codec())


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("personal_data", redact), ("byte_bpe", tokenize)]

#: SQL can't express the learned stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
