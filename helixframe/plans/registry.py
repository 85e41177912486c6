"""Registered queries of the sequence operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, dataflow, files, index, strings

ALL = strings.QUERIES | index.QUERIES | alignment.QUERIES | dataflow.QUERIES | files.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings.qgram_best_diagonal(spark, sf_dir)


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
