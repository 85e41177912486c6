"""Exact dedup by a 128-bit content hash, with the bytes compared inside every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, keep_rows, own_key, read_table

#: Characters that do not count when two texts are compared.
IGNORED = " \t\n\x0b\x0c\r"
#: Rows of one hash that are compared with the representative in one salt bucket.
ROWS_PER_SALT = 1024


def normalised(text: Column) -> Column:
    """The text without spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: ``doc_id, sha, own, rep, c`` (its key, the key order of its group's representative, the group's size)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(text).alias("n"), own_key(F.col(id_col), F.col(text_col)).alias("own"))
    src = src.withColumn("h", F.md5("norm"))
    rows = cut(src.select("doc_id", "h", F.sha2("norm", 256).alias("sha"), "n", "own"))

    # the longest text, then the smallest id, then the text's hash; a missing id comes last
    order = F.struct((-F.col("n")).alias("n"), F.col("own.none").alias("none"), F.col("own.id").alias("id"), F.col("own.a").alias("a"), F.col("own.b").alias("b"))
    # written, so that the joins below are joins of two scans, whose large partitions can be split
    per_hash = cut(rows.groupBy("h").agg(F.count("*").alias("c"), F.min(order).alias("rep")))
    many = per_hash.where("c > 1").withColumn("salts", F.ceil(F.col("c") / ROWS_PER_SALT).cast("int"))

    # compare the bytes of each row with those of its representative; rows are dealt to salts by number, as ids may repeat
    own = src.withColumn("at", F.monotonically_increasing_id()).join(many.select("h", "salts"), "h")
    own = own.select("h", F.pmod(F.col("at"), F.col("salts")).cast("int").alias("salt"), "own", "norm")
    # the representatives are met by hash and key, so no group's rows come together here
    reps = src.withColumn("rep", order).join(many.select("h", "rep", "salts"), ["h", "rep"]).groupBy("h", "salts").agg(F.min("norm").alias("rep_norm"))
    reps = reps.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "rep_norm")
    differ = own.join(reps, ["h", "salt"]).where("norm <> rep_norm")
    differ = cut(differ.select("own", "h", F.concat(F.lit("="), "norm").alias("alt")).distinct())
    if differ.isEmpty():
        out = rows.join(per_hash, "h")
    else:
        keyed = cut(rows.join(differ, ["h", "own"], "left").withColumn("alt", F.coalesce("alt", F.lit(""))))
        groups = cut(keyed.groupBy("h", "alt").agg(F.count("*").alias("c"), F.min(order).alias("rep")))
        out = keyed.join(groups, ["h", "alt"])
    return out.select("doc_id", "sha", "own", "rep", "c")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by the MD5 of the normalised text; per hash the row with the longest original
    text, then the smallest id, represents the group.  Every other row of a group of two or more is
    then compared byte for byte with its representative.  Rows that differ in spite of an equal hash
    form groups of their own, keyed by hash and text.

    Plan: the ids, hashes and lengths are written once to the checkpoint folder (no text); the
    aggregation per hash is combined before the shuffle.  For the comparison, texts are shuffled once,
    to their hash and a salt, and only those of hashes that occur more than once; each salt bucket
    gets a copy of the representative, one per ``ROWS_PER_SALT`` rows.  A group that holds a third of
    all rows is therefore spread over as many tasks as its size asks for, whatever its rows' ids.

    Defined cases: a null text equals an empty one (and one of white space only); repeated rows with
    one id are rows of their own, kept if their id is the one that stays; a null id is kept as it is and
    loses to any other id in a tie; an empty table gives an empty result; very long texts are hashed and
    compared whole; other columns are ignored, whatever their names.
    """
    rep = F.when(~F.col("rep.none"), F.col("rep.id"))
    out = _grouped(docs, id_col, text_col)
    return out.select("doc_id", rep.alias("keep_id"), F.col("c").alias("group_size"), F.col("doc_id").eqNullSafe(rep).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns as they are, whatever their names.

    The row with the longest original text stays, then the one with the smallest id (one without an id
    last), then by the text's hash; of rows that are equal in id and text any one stays.  Rows are known
    by id and text, so rows that repeat an id, or have none, are told apart.
    """
    same = " AND ".join(f"own.{c} = rep.{c}" for c in ("none", "id", "a", "b"))
    keep = cut(_grouped(docs, id_col, text_col).where(same).groupBy("own").agg(F.count("*").alias("n")))
    return keep_rows(docs, own_key(F.col(id_col), F.col(text_col)), keep)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (
  SELECT doc_id, t,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
