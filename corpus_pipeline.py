"""A pipeline over documents: each stage applies one operator to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import decontaminate, language, ngram_join, pieces, secrets
from veilscan.llm.common import read, store
from veilscan.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a text or without a letter, whose language is none, go."""
    return language.known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return ngram_join.deduplicated(docs, n=5, num=80, den=100)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their piece ids and the text that these decode to."""
    return pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]

#: Language models, decoding worklists and piece ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
