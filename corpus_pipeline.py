"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes the documents that its predecessor kept and all but the last give back rows of documents. `run`
writes every stage's rows to the shared folder and reads them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language, near_copies, packing
from tessera.llm.cluster import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to whose text the network, fitted to the labels of these documents, gives a language."""
    return language.keep(docs, language.fit(docs))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 5-word shingle Jaccard similarity of 0.8 or more."""
    return near_copies.first_of_each(docs, k=5, p=4, q=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences of at most 1024 tokens and 8 segments."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The stages are learned, iterative or tokenizer-bound; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
