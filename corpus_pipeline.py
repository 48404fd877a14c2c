"""The corpus pipeline: language, exact copies, near copies, benchmark passages, tokens.

Each stage reads what the one before has written.  Its decisions take effect: rows
that a stage drops never reach the next.  All stages but the last keep the columns of
the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from tillflow.llm import bpe, copies, decontamination, dedup, langid
from tillflow.llm.queries import BPE_FILE, read, shown_document
from tillflow.llm.tables import land


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return langid.accepted(docs, langid.page_evidence(read(spark, sf_dir, "pages"), shown_document()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return dedup.unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Five-word shingles and a Jaccard similarity of 0.8 or more, decided on the sets.
    """
    return copies.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, text``: the ids of each document, and what they decode to."""
    return bpe.encode(docs, tokenizer_path(BPE_FILE), spelled=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens),
]

# Tokens and fingerprints have no SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
