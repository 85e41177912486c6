"""Index tables on disk: built once, read by column and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import suffix as X

#: Rows between two entries of the occurrence table, and between two sampled places.
OCC_EVERY, SSA_EVERY = 64, 32


def build_index(references: DataFrame, path: str, id_col: str = "ref_id", seq_col: str = "seq", backward: bool = False) -> None:
    """Writes Parquet tables below ``path``: ``genome`` (references with offset and length), ``sa`` (the set's
    suffix array with the symbol before each suffix: the BWT), ``ssa`` (its sample) and ``occ``; with
    ``backward`` the same of the reversed references below ``reverse``."""
    from ..operators.primitives import scan

    genome = scan(references.withColumn("length", F.length(seq_col).cast("long")), [id_col], F.col("length"), "offset", exclusive=True)
    genome.write.mode("overwrite").parquet(f"{path}/genome")
    for folder, rows in (("forward", references), ("reverse", references.withColumn(seq_col, F.reverse(seq_col)))):
        if folder == "reverse" and not backward:
            continue
        sa = X.suffix_array(rows, id_col, seq_col)
        sa.write.mode("overwrite").parquet(f"{path}/{folder}/sa")
        kept = sa.sparkSession.read.parquet(f"{path}/{folder}/sa")
        X.sample_by_value(kept, SSA_EVERY).write.mode("overwrite").parquet(f"{path}/{folder}/ssa")
        block = F.floor(F.col("sa_rank") / OCC_EVERY)
        counts = kept.groupBy(block.alias("block")).agg(*(F.sum(F.when(F.col("prev") == x, 1).otherwise(0)).alias(f"n_{x.lower()}") for x in "ACGT"))
        for x in "acgt":
            counts = scan(counts, ["block"], F.col(f"n_{x}"), x, exclusive=True)
        counts.select("block", *"acgt").write.mode("overwrite").parquet(f"{path}/{folder}/occ")


def load_index(spark: SparkSession, path: str, parts: tuple[str, ...] = ("genome", "sa"), direction: str = "forward") -> dict[str, DataFrame]:
    """The asked tables; others are not opened."""
    return {p: spark.read.parquet(f"{path}/genome" if p == "genome" else f"{path}/{direction}/{p}") for p in parts}


def serve_index(spark: SparkSession, path: str, name: str, parts: tuple[str, ...] = ("genome", "sa")) -> None:
    """Makes the tables views ``global_temp.<name>_<part>``, shared by all sessions of the application and kept
    in memory where they fit; this session also has them as ``<name>_<part>``."""
    for p, df in load_index(spark, path, parts).items():
        df.createOrReplaceGlobalTempView(f"{name}_{p}")
        spark.catalog.cacheTable(f"global_temp.{name}_{p}")
        spark.table(f"global_temp.{name}_{p}").createOrReplaceTempView(f"{name}_{p}")


def stop_serving(spark: SparkSession, name: str, parts: tuple[str, ...] = ("genome", "sa")) -> None:
    for p in parts:
        spark.catalog.dropTempView(f"{name}_{p}")
        spark.catalog.uncacheTable(f"global_temp.{name}_{p}")
        spark.catalog.dropGlobalTempView(f"{name}_{p}")
