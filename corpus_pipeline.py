"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows the one before it kept. All but the last return the columns of ``documents``; the last
returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from periodlens.llm import language, mixing, near_copies, packing, secret_scan
from periodlens.llm.common import read
from periodlens.sources.tables import work_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from the labelled rows; those without letters or of unsure language go.

    A missing language is filled in.
    """
    return language.accepted(docs, language.train(docs), lang_col="lang")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity of 0.8 or more on shingles of five words.

    Candidates are what ``op4_simhash`` groups and what shares a band of MinHashes; all of them are measured.
    """
    return near_copies.keep_one(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_scan.redact(docs, length_col="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_masking), ("source_mix", source_mixing),
    ("packing", sequence_packing),
]
# The stages hash, tokenize and fit a model, which DuckDB has no functions for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows and the next one reads them."""
    docs = read(spark, sf_dir, "documents")
    base = work_dir(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{base}/{i}-{name}")
        docs = spark.read.parquet(path)
    return docs
