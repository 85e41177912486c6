"""A corpus pipeline: documents go through five operators in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm._shared import cut, read_table
from helixframe.llm.bpe import encode_digests
from helixframe.llm.exact_dedup import drop_exact
from helixframe.llm.mixing import mixed_documents
from helixframe.llm.simhash import drop_near
from helixframe.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, once for each epoch that uses them."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return encode_digests(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash", simhash), ("mixing", mixing), ("bpe", bpe)]

#: Fitted models, hashes of other libraries and tokenizers have no SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next one reads them.

    Nulls in any column, empty and very long texts, ties, repeated rows and extra columns have the results
    that the operators' docstrings define; an empty table goes through as an empty table.
    """
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
