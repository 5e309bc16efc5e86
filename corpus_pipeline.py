"""The text pipeline: language ID, near-duplicates, benchmark passages, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from neoquarry.llm import bpe, decontamination, language_id, near_dup, pii
from neoquarry.llm.common import table
from neoquarry.llm.queries import tokenizer_path
from neoquarry.session import shared_dir


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; those that no language is found for go."""
    return language_id.accepted_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dup.representatives(docs, near_dup.Similarity(words=5, percent=80))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids and the text they give."""
    return bpe.encoded(docs, tokenizer_path())


STAGES = [
    ("language_id", languages),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("bpe", tokens),
]

# the languages are found by models that SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
