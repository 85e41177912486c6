"""Structured Streaming over a folder of reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qgram as Q
from ..operators import seeds as E


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of ``read_id, seq`` of text files with a read per line; batches are bounded by files."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    seq = F.regexp_replace("value", r"[^\x21-\x7E]", "")
    return lines.select(F.xxhash64("value").alias("read_id"), seq.alias("seq")).where("seq <> ''")


def stream_hits(reads: DataFrame, postings: DataFrame, q: int, interval: int) -> DataFrame:
    """The stream's seeds joined with a static index: one row per hit."""
    seeds = E.seeds(reads, q, interval, "read_id").select("read_id", F.col("begin").alias("read_pos"), F.col("seed").alias("qgram"))
    return Q.hits(seeds, postings)


def stream_counts(hits: DataFrame, *keys: str) -> DataFrame:
    """Running numbers of hits; for output mode complete or update."""
    return hits.groupBy(*keys).agg(F.count("*").alias("n"))


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, batch by batch; a restart goes on where it ended."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
