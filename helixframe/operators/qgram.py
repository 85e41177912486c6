"""Q-gram indices, searches and counts by diagonal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from .primitives import scan
from .seeds import seeds


def string_grams(seq: Column, q: int, pad_tail: bool = True) -> Column:
    """The q-grams of one string by place; with ``pad_tail`` one for every place, filled up with A."""
    padded = F.concat(seq, F.lit("A" * (q - 1))) if pad_tail else seq
    last = F.length(seq) - 1 if pad_tail else F.length(seq) - q
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.substring(padded, i + 1, F.lit(q)).alias("qgram"))))


def string_postings(strings: DataFrame, q: int, id_col: str = "string_id", seq_col: str = "seq", pad_tail: bool = True) -> DataFrame:
    """``string_id, pos, qgram``: one row per place of each string."""
    return strings.select(F.col(id_col), F.explode(string_grams(F.col(seq_col), q, pad_tail)).alias("x")).select(id_col, "x.pos", "x.qgram")


def set_postings(strings: DataFrame, q: int, interval: int = 1, id_col: str = "string_id", seq_col: str = "seq") -> DataFrame:
    """``string_id, pos, qgram`` of the full windows only."""
    return seeds(strings, q, interval, id_col, seq_col).select(id_col, F.col("begin").alias("pos"), F.col("seed").alias("qgram"))


def index(postings: DataFrame, *place: str) -> DataFrame:
    """``qgram, n, begin, end``: the unique q-grams with their half-open slot ranges in q-gram order.

    A slot is a place in the postings ordered by q-gram and ``place``; ``slots`` gives them.  Counting is
    combined before the shuffle; the ranges come from a scan that no single task holds.
    """
    unique = postings.groupBy("qgram").agg(F.count("*").alias("n"))
    out = scan(unique, ["qgram"], F.col("n"), "end")
    return out.select("qgram", "n", (F.col("end") - F.col("n")).alias("begin"), "end")


def slots(postings: DataFrame, ranges: DataFrame, *place: str) -> DataFrame:
    """The postings with ``slot``."""
    within = F.row_number().over(W.partitionBy("qgram").orderBy(*place)) - 1
    return postings.withColumn("__w", within).join(ranges.select("qgram", "begin"), "qgram").withColumn("slot", F.col("begin") + F.col("__w")).drop("__w", "begin")


def rank(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each query q-gram's slot range; null where the index has none."""
    return queries.join(ranges.select("qgram", "begin", "end", "n"), "qgram", "left")


def hits(queries: DataFrame, postings: DataFrame, max_occ: int | None = None) -> DataFrame:
    """Every meeting of a query q-gram with the index: the columns of both sides.

    One equi-join; large partitions of frequent q-grams can be split by adaptive execution.  With
    ``max_occ`` q-grams that occur more often in the index are left out, as repeats.
    """
    if max_occ is not None:
        rare = postings.groupBy("qgram").agg(F.count("*").alias("__n")).where(F.col("__n") <= max_occ).drop("__n")
        postings = postings.join(rare, "qgram", "left_semi")
    return queries.join(postings, "qgram")


def diagonal(query_pos: Column, index_pos: Column, interval: int = 1) -> Column:
    """The snapped difference of the places, signed."""
    return S.snap(query_pos.cast("long") - index_pos.cast("long"), interval)


def count_by_diagonal(found: DataFrame, keys: list[str], query_pos: str, index_pos: str, interval: int) -> DataFrame:
    """``keys, diag, n``: q-gram counting."""
    return found.groupBy(*keys, diagonal(F.col(query_pos), F.col(index_pos), interval).alias("diag")).agg(F.count("*").alias("n"))


def best_diagonal(counts: DataFrame, key: list[str], other: list[str]) -> DataFrame:
    """Per key the diagonal with most hits; ties go to the smallest of the other columns and diagonal."""
    first = F.min_by(F.struct(*other, "diag", "n"), F.struct(-F.col("n"), *other, F.col("diag")))
    return counts.groupBy(*key).agg(first.alias("b")).select(*key, "b.*")


def page(found: DataFrame, order: list[str], begin: int, end: int) -> DataFrame:
    """Hits [begin, end) in the order of ``order`` (a total order), with their number ``hit``."""
    numbered = scan(found, order, F.lit(1), "hit").withColumn("hit", F.col("hit") - 1)
    return numbered.where((F.col("hit") >= begin) & (F.col("hit") < end))


#: Q-grams of one word of a group index.
WORD = 32


def group_index(postings: DataFrame, q: int) -> tuple[DataFrame, DataFrame]:
    """A q-group index of ``postings``: words and slots.

    Words (``word, bits, before``) say which of the ``WORD`` q-gram numbers of a word occur, and how many
    occur in the words before; the i-th occurring number has the half-open range ``begin, end`` of slots
    (``nth, code, n, begin, end``) in the order of the numbers.  Words without a q-gram are left out, as the
    number of all possible ones grows with the alphabet's q-th power.
    """
    coded = postings.groupBy(S.qgram_code(F.col("qgram"), q).alias("code")).agg(F.count("*").alias("n"))
    slots_ = scan(coded, ["code"], F.col("n"), "end").select("code", "n", (F.col("end") - F.col("n")).alias("begin"), "end")
    slots_ = scan(slots_, ["code"], F.lit(1), "nth", exclusive=True)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("code"), F.lit(WORD)).cast("int"))
    words = slots_.groupBy(F.floor(F.col("code") / WORD).alias("word")).agg(F.sum(bit).alias("bits"), F.min("nth").alias("before"))
    return words, slots_


def group_range(queries: DataFrame, words: DataFrame, slots_: DataFrame, q: int) -> DataFrame:
    """``queries`` (``qgram``) with ``begin, end``: a word tells whether a q-gram occurs and, by the bits below
    its own, the number of its slots; null where it does not occur."""
    asked = queries.withColumn("__code", S.qgram_code(F.col("qgram"), q))
    at = F.pmod(F.col("__code"), F.lit(WORD)).cast("int")
    met = asked.join(words.select(F.col("word").alias("__w"), "bits", "before"), F.floor(F.col("__code") / WORD) == F.col("__w"), "left")
    here = F.call_function("shiftright", F.col("bits"), at).bitwiseAND(1) == 1
    below = F.bit_count(F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at) - 1))
    met = met.withColumn("__nth", F.when(here, F.col("before") + below))
    return met.join(slots_.select(F.col("nth").alias("__k"), "begin", "end"), F.col("__nth") == F.col("__k"), "left").select(*queries.columns, "begin", "end")
