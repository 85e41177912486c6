"""Helpers that several corpus operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import cut, forget

__all__ = ["cut", "connected", "forget", "keep_rows", "own_key", "read_table", "shuffle_width"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_key(doc_id: Column, text: Column) -> Column:
    """What a row is known by: its id, or that it has none, and 128 bits of its text.  Rows with an id come first."""
    doc_id = doc_id.cast("long")
    return F.struct(
        doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"),
        F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("second")).alias("b"),
    )


def keep_rows(docs: DataFrame, key: Column, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``keep`` (``own``, and ``n``, the number of rows that have it), one for each.

    Keys of one row need no more than a semi-join; only rows that share a key are looked at again.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("own"))
    out = packed.join(keep.where("n = 1").select("own"), "own", "left_semi")
    more = keep.where("n > 1").select("own")
    if not more.isEmpty():
        out = out.unionByName(packed.join(more, "own", "left_semi").dropDuplicates(["own"]))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``(a, b)`` long pairs -> ``(node, root)``.

    ``root`` is the smallest node of the component.  Alternating large-star and small-star
    contraction: each half-round takes a minimum per node (combined before the shuffle), writes it, and
    joins it back to the edges.  Both sides of these joins are scans, so that adaptive execution can
    divide a hub's edges, and no neighbourhood is ever gathered into one row.  Self-loops and null ends
    are ignored; an empty table gives an empty result.  Each step is written to the checkpoint folder,
    which bounds the lineage, and deleted when the next round is written.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    e = cut(e.distinct())
    before = _signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # large-star: every neighbour above u moves to the smallest of u and its neighbours
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        big = cut(big.where("a <> b").distinct())
        # small-star: the neighbours below u, and u, move to the smallest of them
        least = cut(big.groupBy("a").agg(F.min("b").alias("m")))
        small = big.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m"
        )
        old, e = e, cut(small.select(F.col("s.x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        forget(old, low, big, least)
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).groupBy("node").agg(F.min("root").alias("root"))
