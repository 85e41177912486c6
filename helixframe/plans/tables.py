"""Sequence tables derived from the driver's tables, on both sides alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S

DNA = "upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g'))"
#: Common table expressions for DuckDB.
DOCS = f"dna AS (SELECT doc_id, {DNA} AS seq FROM documents)"
ITEMS = f"ref AS (SELECT item_id, {DNA} AS seq FROM benchmark)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, seq``: the A, C, G, T of each document."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.as_dna(F.col("text")).alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, seq``: the A, C, G, T of each benchmark item."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", S.as_dna(F.col("text")).alias("seq"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
